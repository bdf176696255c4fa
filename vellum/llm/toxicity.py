"""Abusive, hateful or sexual language by compression distance (problem 9).

Two Zstandard dictionaries, one of ordinary and one of toxic text, compress the
same short window; what the toxic one saves against the ordinary one is the
window's score, in bytes, and a document scores as its worst window.

Labels are per document, while a toxic document is mostly ordinary. Training
therefore works on windows and in folds: windows of a fold are scored by
dictionaries from the other folds; windows of toxic documents that score above
nearly all ordinary ones become the toxic text, and ordinary windows that score
like toxic ones (wrong labels) leave the ordinary text, unless what they have in
common with the toxic text is no rarer in ordinary documents: wrong labels are
few, while an ordinary phrase is in documents of both kinds. The threshold is the
one with the best F1 over held-out document scores, false alarms weighed by
``ALARM`` since toxic documents are over-represented among the labels.

Labelled documents are bounded by ``MOST_LABELS`` (taken by hash of the key, all
if fewer), so the model has a fixed size. Every document is scored whole.

Results: null, empty and blank texts score null and are no cases; without labels
of both kinds nothing can be trained and all scores are null; null sources form a
group of their own; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.plainform import transducer

#: Most labelled documents used for training.
MOST_LABELS = 8_000
FOLDS = 5
#: Least threshold: about three Chinese characters more than chance.
LEAST = 8
#: How many times rarer toxic documents are in the corpus than among the labelled ones.
ALARM = 5
ROUNDS = 2
#: Held-out score beyond which an ordinary window counts as wrongly labelled: that of a toxic one.
CLEAN = LEAST
#: A run of the toxic text counts as ordinary where it is in 2 or more ordinary documents, and in one for each WRONG toxic ones.
#: One in OFTEN toxic documents, and as many for each ordinary one, is a mark of toxic text.
RUN, WRONG, OFTEN = 4, 3, 6
#: Toxic documents from which on windows made of ordinary runs leave the toxic text.
MANY = 100
LEVEL = 3
#: Ordinary dictionaries, each of a share of the ordinary windows.
SHARDS = 3
#: Bytes of a dictionary, and of the segments it is put together from.
SIZE, SEGMENT = 262_144, 64
_TRAINED = b"\x37\xa4\x30\xec"
WINDOW, STRIDE = 30, 15
QUANTILE = 0.998

_SPLIT = re.compile(r"(?<=[^\W\d_])[-/.*_~·|丨'`^+\s]*[-/.*_~·|丨'`^+](?=[^\W\d_])")
_CLAUSE = re.compile(r"[^。！？!?；;，,\n…]+[。！？!?；;，,\n…]*")


def tidy(text: str) -> str:
    """Plain lower-case text without signs pushed between letters."""
    return _SPLIT.sub("", text).lower()


def windows(text: str) -> list[str]:
    """Clauses of a plain text; long ones as overlapping windows."""
    out = []
    for clause in _CLAUSE.findall(tidy(text)):
        clause = clause.strip()
        if len(clause) <= WINDOW + 8:
            if clause:
                out.append(clause)
        else:
            out += [clause[i : i + WINDOW] for i in range(0, len(clause) - 8, STRIDE)]
    return out


def _compressor(content: bytes) -> Callable[[str], int]:
    import zstandard

    dictionary = zstandard.ZstdCompressionDict(content) if content[:4] == _TRAINED else zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return lambda w: len(compress(w.encode("utf-8", "replace")))


def build(parts: list[str], size: int) -> bytes:
    """A dictionary trained on ``parts``; their text itself where there is too little to train on."""
    import zstandard

    samples = [p.encode("utf-8", "replace") for p in parts]
    content = b"\n".join(samples) or b"\n" * 8
    if len(content) <= size:
        return content
    return zstandard.train_dictionary(size, samples, k=SEGMENT, d=8, level=LEVEL).as_bytes()


def build_all(parts: list[str], size: int) -> tuple[bytes, ...]:
    """``SHARDS`` dictionaries, each of every so many-th part."""
    return tuple(build(parts[i::SHARDS], size) for i in range(SHARDS)) if sum(map(len, parts)) > size else (build(parts, size),)


def scorer(ordinary: tuple[bytes, ...], toxic: bytes) -> Callable[[str], int]:
    """Bytes that the toxic dictionary saves on a window against the best ordinary one."""
    first, *others = map(_compressor, ordinary)
    t = _compressor(toxic)

    def score(w: str) -> int:
        saved = first(w) - t(w)
        return min(saved, *(o(w) + saved - first(w) for o in others)) if saved > 0 and others else saved

    return score


def runs_of(w: str) -> set[str]:
    """Runs of ``RUN`` characters of a window; a shorter one is a run itself."""
    return {w[i : i + RUN] for i in range(max(1, len(w) - RUN + 1))}


def in_documents(documents: Iterable[list[str]]) -> Counter[str]:
    """In how many documents, given as windows, each run is."""
    return Counter(r for windows_of in documents for r in set().union(*map(runs_of, windows_of)))


def fit(texts: list[str], labels: list[int]) -> dict | None:
    """Dictionary texts and threshold from plain labelled texts."""
    order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))  # whatever order the rows came in
    random.Random(7).shuffle(order)
    cut = [windows(texts[i]) for i in order]
    label = [labels[i] for i in order]
    if not 0 < sum(label) < len(label):
        return None
    fold = [i % FOLDS for i in range(len(order))]
    ordinary = {i: w for i, w in enumerate(cut) if not label[i]}
    toxic = {i: w for i, w in enumerate(cut) if label[i]}

    def held_out() -> list[list[int]]:
        scores: list[list[int]] = [[]] * len(cut)
        for f in range(FOLDS):
            score = scorer(*(make([w for i, ws in side.items() if fold[i] != f for w in ws], SIZE) for side, make in ((ordinary, build_all), (toxic, build))))
            for i in range(f, len(cut), FOLDS):
                scores[i] = [score(w) for w in cut[i]]
        return scores

    in_ordinary, in_toxic = in_documents(ordinary.values()), in_documents(toxic.values())
    # runs of so many more toxic documents stand in an ordinary one by a wrong label, though two such windows hide each other's scores
    marks = {r for r, n in in_toxic.items() if n >= OFTEN * max(1, in_ordinary[r])}
    ordinary = {i: [w for w in ws if marks.isdisjoint(runs_of(w))] for i, ws in ordinary.items()}

    def usual_text(w: str) -> bool:
        """Whether a third of the runs is in no fewer ordinary documents than toxic ones, and none is a mark; few labels don't tell."""
        runs = runs_of(w)
        return sum(label) >= MANY and 3 * sum(in_ordinary[r] >= max(2, in_toxic[r]) for r in runs) >= len(runs) and marks.isdisjoint(runs)

    scores = held_out()
    for _ in range(ROUNDS):
        usual = max(2.0, float(np.quantile([s for i in ordinary for s in scores[i]] or [0], QUANTILE)))
        toxic = {i: [w for w, s in zip(cut[i], scores[i]) if s > usual and not usual_text(w)] for i in toxic}
        # runs of the toxic text that are rare in ordinary documents, as wrong labels are
        rare = {r for ws in toxic.values() for w in ws for r in runs_of(w) if in_ordinary[r] < max(2, in_toxic[r] / WRONG)}
        ordinary = {i: [w for w, s in zip(cut[i], scores[i]) if marks.isdisjoint(runs_of(w)) and (s <= CLEAN or rare.isdisjoint(runs_of(w)))] for i in ordinary}
        scores = held_out()
    top = np.array([max(s, default=-99) for s in scores])
    truth = np.array(label, bool)
    steps = np.arange(LEAST, 41)
    # F1 with false alarms weighed up: labels over-represent toxic documents
    hits, alarms = (np.array([(side & (top >= t)).sum() for t in steps]) for side in (truth, ~truth))
    f1 = 2 * hits / (hits + ALARM * alarms + truth.sum())
    kept = [w for i in toxic for w in toxic[i]]
    return {"ordinary": build_all([w for ws in ordinary.values() for w in ws], SIZE), "toxic": build(kept, SIZE), "kept": kept, "threshold": int(steps[int(np.argmax(f1))])}


@lru_cache(maxsize=2)
def _scorer(ordinary: tuple[bytes, ...], toxic: bytes) -> Callable[[str], int]:
    return scorer(ordinary, toxic)


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_LABELS) -> dict | None:
    """The model of at most ``most`` labelled documents."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    known = known.orderBy(F.xxhash64(key)).limit(most)
    rows = documents.select(key, F.col(text).alias("text")).where("text is not null").join(F.broadcast(known), key).select("text", "label").collect()
    plain = transducer().array(pa.array([r["text"] for r in rows], pa.string()))[0].to_pylist()
    return fit(plain, [int(r["label"] > 0) for r in rows])


def toxic_scores(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", carried: str | None = None) -> DataFrame:
    """(key, score, worst, toxic) of every document: bytes saved on its worst window, that window, and whether it passes the threshold.

    ``carried``, a string column, comes along under that name.
    """
    model = train(documents, labels, key, text)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        score = _scorer(m["ordinary"], m["toxic"]) if m else None
        for batch in batches:
            scores: list[int | None] = []
            worst: list[str | None] = []
            for t in transducer().array(batch.column(1))[0].to_pylist():
                ws = windows(t) if score and t else []
                best = max(((score(w), w) for w in ws), default=(None, None))
                scores.append(best[0])
                worst.append(best[1])
            toxic = [None if s is None else s >= m["threshold"] for s in scores]
            columns = [batch.column(0), pa.array(scores, pa.int32()), pa.array(worst, pa.string()), pa.array(toxic, pa.bool_())]
            yield pa.record_batch([*columns, *batch.columns[2:]], names=[key, "score", "worst", "toxic", "carried"][: batch.num_columns + 2])

    more, named = ([F.col(carried).cast("string").alias("carried")], ", carried string") if carried else ([], "")
    out = documents.select(F.col(key), F.col(text), *more).mapInArrow(run, f"{key} {kind}, score int, worst string, toxic boolean{named}")
    return out.withColumnRenamed("carried", carried) if carried else out


def toxic_rates(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Documents, toxic documents and their share per source."""
    marks = toxic_scores(documents, labels, key, text, source)
    n = F.count_if(F.coalesce("toxic", F.lit(False)))
    return marks.groupBy(source).agg(F.count("*").alias("n_docs"), n.alias("n_toxic"), (n / F.count("*")).alias("toxic_rate"))
