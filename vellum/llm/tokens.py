"""Token ids of whole texts by a public byte-level BPE vocabulary (problem 7).

Encoding is a monoid over text: leaves of up to ``LEAF`` characters are encoded
alone, neighbours are joined up a balanced tree. A join re-encodes a window
around the seam that grows until both its ends lie where the pre-tokenizer must
break whatever surrounds them; tokens outside cannot change, so the result
equals that of the whole text. Where a single piece of letters, digits or signs
reaches far over the seam, the window grows by tokens instead, until the tokens
at both its ends keep apart from their neighbours when encoded together: a
sequence of tokens is the encoding of a piece if every two neighbours are.
Decoding is plain concatenation, up the tree as well.

Results: null and empty texts give the empty list; strings of special tokens
are ordinary text; white space, control and broken characters are encoded as
stored; the length is not limited. Repeated rows and null keys are kept; other
columns are ignored.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a leaf of the tree: a few lines of text, so that ordinary documents pass the tree.
LEAF = 256
#: Characters of a window beyond which it grows by tokens where it can.
WINDOW = 128


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    major = unicodedata.category(c)[0]
    return major if major in "LN" else "S" if re.match(r"\s", c) and c not in "\x1c\x1d\x1e\x1f" else "S?" if c.isspace() else "O"


def must_break(a: str, b: str) -> bool:
    """Whether pieces end between neighbours ``a`` and ``b`` in every text.

    Runs of letters, digits and signs end where the class changes. White space
    may belong to what follows, and an apostrophe may begin a contraction.
    """
    x, y = _kind(a), _kind(b)
    return x in ("L", "N", "O") and a != "'" and x != y and "S?" not in (x, y) and unicodedata.category(b) != "Cn" and unicodedata.category(a) != "Cn"


class Encoder:
    """Ids of texts by one vocabulary of ranks."""

    def __init__(self, data: bytes, leaf: int = LEAF) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        coding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode, self._piece, self._bytes = coding.encode_ordinary, coding._encode_single_piece, coding.decode_single_token_bytes
        self.leaf = leaf

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """Ids of ``left + right``."""
        if not left or not right:
            return left_ids or right_ids
        if (joined := self._within(left, left_ids, right, right_ids)) is not None:
            return joined
        p = next((i for i in range(len(left) - 1, 0, -1) if must_break(left[i - 1], left[i])), 0)
        q = next((i for i in range(1, len(right)) if must_break(right[i - 1], right[i])), len(right))
        head = left_ids[: len(left_ids) - len(self._encode(left[p:]))] if p else []
        tail = right_ids[len(self._encode(right[:q])) :] if q < len(right) else []
        return head + self._encode(left[p:] + right[:q]) + tail

    def _within(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int] | None:
        """Ids of ``left + right`` where one long run of letters, digits or signs lies over the seam; else None."""
        kind = _kind(left[-1])
        if kind not in ("L", "N", "O") or _kind(right[0]) != kind:
            return None
        reach = []  # characters of the run on either side of the seam
        for side, places in ((left, range(len(left) - 1, -1, -1)), (right, range(len(right)))):
            reach.append(next((n for n, i in enumerate(places) if _kind(side[i]) != kind or side[i] == "'"), len(side)))
        if min(reach) <= WINDOW:
            return None
        room = len(left[-reach[0] :].encode("utf-8", "replace")), len(right[: reach[1]].encode("utf-8", "replace"))
        count = 8
        while count < min(len(left_ids), len(right_ids)):
            before, after = (b"".join(map(self._bytes, ids)) for ids in (left_ids[-count - 1 :], right_ids[: count + 1]))
            if len(before) > room[0] or len(after) > room[1]:
                return None  # the window would leave the run
            first, last = left_ids[-count - 1], right_ids[count]
            head, tail = self._bytes(first), self._bytes(last)
            ids = self._piece(before[len(head) :] + after[: len(after) - len(tail)])
            if self._piece(head + self._bytes(ids[0])) == [first, ids[0]] and self._piece(self._bytes(ids[-1]) + tail) == [ids[-1], last]:
                return left_ids[:-count] + ids + right_ids[count:]
            count *= 2
        return None

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``."""
        if len(text) <= self.leaf:
            return self._encode(text)
        half = len(text) // 2
        return self.join(text[:half], self.encode(text[:half]), text[half:], self.encode(text[half:]))


@lru_cache(maxsize=4)
def encoder(data: bytes) -> Encoder:
    return Encoder(data)


def _map(df: DataFrame, key: str, text: str, vocabulary: str, schema: str, build) -> DataFrame:
    data = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(data.value).encode
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                yield build(part.column(0), (encode(t) if t else [] for t in part.column(1).to_pylist()), part.num_rows)

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row."""

    def build(keys: pa.Array, lists: Iterator[list[int]], n: int) -> pa.RecordBatch:
        arrays = [np.array(x, np.int32) for x in lists]
        ends = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))
        return pa.record_batch([keys, ids], names=[key, "ids"])

    return _map(df, key, text, vocabulary, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>", build)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row."""

    def build(keys: pa.Array, lists: Iterator[list[int]], n: int) -> pa.RecordBatch:
        return pa.record_batch([keys, pa.array(np.fromiter((len(x) for x in lists), np.int64, n))], names=[key, "n_tokens"])

    return _map(df, key, text, vocabulary, f"{key} {df.schema[key].dataType.simpleString()}, n_tokens bigint", build)
