"""Character runs of many texts at once, on Arrow buffers and numpy.

Texts are compared in plain form without white space, and with one width of
punctuation: a full-width comma and a plain one look alike, though both are
plain form in Chinese text. A text's set is that of its runs of five
characters, each run held as a 64-bit hash; a text of one to four characters
counts as one run.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from vellum.llm.plainform import KEPT, transducer

RUN = 5
PAD = "￿"
#: Characters worked on at once; bounds the memory of a task whatever the batch holds.
CHARS = 1_500_000
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; spreads neighbouring values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def squeezed(texts: pa.Array) -> pa.Array:
    """Plain form without white space, punctuation in its narrow width."""
    plain, _ = transducer().array(texts)
    plain = pc.replace_substring_regex(plain, r"[\s\x{85}\x{2028}\x{2029}]+", "")
    for mark in KEPT:
        plain = pc.replace_substring(plain, mark, unicodedata.normalize("NFKC", mark))
    return plain


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of about ``CHARS`` characters."""
    if not len(texts):
        return
    part = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False)) // CHARS
    starts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(texts)]
    yield from zip(starts[:-1].tolist(), starts[1:].tolist())


def slices(keys: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Non-blank squeezed texts with their keys, in parts of about ``CHARS`` characters."""
    texts = squeezed(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
    keep = pc.fill_null(pc.not_equal(texts, ""), False)
    keys, texts = keys.filter(keep), texts.filter(keep)
    for a, b in parts(texts):
        yield keys.slice(a, b - a), pa.concat_arrays([texts.slice(a, b - a)])


def points(texts: pa.Array, least: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and each text's end; shorter texts are padded to ``least``."""
    texts = pc.utf8_rpad(texts, least, PAD)
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    data = "".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, np.uint32), ends


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest of each text as two int64 arrays."""
    raw = b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts.to_pylist())
    pair = np.frombuffer(raw, ">i8").reshape(-1, 2).astype(np.int64)
    return pair[:, 0].copy(), pair[:, 1].copy()


def run_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct run hashes of every text, one after another, and the end of each text's."""
    cp, ends = points(texts)
    starts = np.r_[0, ends[:-1]]
    n = len(cp) - RUN + 1
    h = cp[:n].astype(np.uint64)
    for j in range(1, RUN):
        h *= np.uint64(_ODD)
        h += cp[j : n + j]
    h = mix(h)
    lengths = ends - starts - RUN + 1
    h = np.concatenate([h[a : a + k] for a, k in zip(starts, lengths)])
    ends = np.cumsum(lengths)
    a = 0
    for b in ends:
        h[a:b].sort()
        a = b
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    keep[np.r_[0, ends[:-1]]] = True
    return h[keep], np.cumsum(np.add.reduceat(keep, np.r_[0, ends[:-1]]))


def jaccard(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shared runs of each pair of squeezed texts, and the size of either set."""
    (x, xe), (y, ye) = run_sets(a), run_sets(b)
    xs, ys = np.r_[0, xe[:-1]], np.r_[0, ye[:-1]]
    shared = np.empty(len(xe), np.int64)
    for i in range(len(xe)):
        both = np.concatenate([x[xs[i] : xe[i]], y[ys[i] : ye[i]]])
        both.sort()
        shared[i] = np.count_nonzero(both[1:] == both[:-1])
    return shared, xe - xs, ye - ys
