"""Near-duplicate texts with small edits (problem 5): a parity-sketch join.

Texts are near when their sets of five-character runs (plain form, no white
space) share at least ``threshold`` of their union. Steps:

1. Equal texts become one class by a 128-bit digest, so copies cost nothing below.
2. Parity sketch: a class's run hashes are spread over the blocks of its size
   band and XORed together block by block. A run in which two sets differ
   changes one block, so the number of unequal blocks is a lower bound of the
   symmetric difference, and near sets must keep whole blocks equal.
3. Pigeonhole join on (band, block, parity word). A set near the lower edge of
   its band also enters the band below, which is where smaller partners are.
   Two equal blocks make a candidate; bands of the smallest sets enter every
   block twice, so that one is enough there. The block counts leave a dozen
   equal usable blocks on average between sets exactly at 0.7, whatever their
   size: a pair at the threshold escapes with a probability of about 1e-4, and
   one at 0.8 with less than 1e-9. For this, sets of 256 runs or more are
   sketched on the runs of a hash range, some 240 to 480 of them. With
   ``exact`` all runs are sketched, in more blocks than two near sets can
   differ in: then no pair escapes, for about three times the rows.
4. Blocks shared by up to ``GROUP`` classes give their pairs. A block that is
   hot within a task is salted there, before the exchange. Larger groups are
   compared in square tiles of bit sketches, of which only pairs within the
   Hamming bound are passed on: no group is held in one task and none is capped.
   The number of comparisons stays quadratic in such a group, at some
   nanoseconds each, as every pair of it may be a link.
5. Every candidate is verified on the whole texts; linked classes are joined
   into groups by alternating stars. Texts are brought to the compared form
   once and staged.

Results: null, empty and blank texts belong to no group; equal texts do, however
short; rows repeated under one key stay one row of the result; null keys are
left out; other columns, whatever their names, are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.components import components
from vellum.llm.grams import digests, jaccard, mix, parts, run_sets, slices
from vellum.plans.staging import stage

THRESHOLD = 0.7
#: Largest group of classes under one key whose pairs are listed at once; larger ones go in tiles.
GROUP = 128
TILE = 2048
#: Ids up to this count are broadcast to pick texts; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SKETCH_BITS = 1024


def documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) of the rows that can have a partner."""
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null and text <> ''")


def prepared(docs: DataFrame) -> DataFrame:
    """(id, h1, h2, text): squeezed text and its digest, of every row with a text; staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1)):
                h1, h2 = digests(texts)
                yield pa.record_batch([ids, pa.array(h1), pa.array(h2), texts], names=["id", "h1", "h2", "text"])

    return stage(docs.mapInArrow(run, "id bigint, h1 bigint, h2 bigint, text string"), "squeezed")


def first_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Digest and text of each class of (h1, text) rows, once per partition."""
    seen: set[int] = set()
    for batch in batches:
        texts = batch.column(1)
        for a, b in parts(texts):
            h1 = batch.column(0).to_numpy(zero_copy_only=False)[a:b]
            new = np.zeros(len(h1), bool)
            for i, h in enumerate(h1.tolist()):
                if h not in seen:
                    seen.add(h)
                    new[i] = True
            if new.any():
                yield h1[new], pa.concat_arrays([texts.slice(a, b - a).filter(pa.array(new))])


class Salter:
    """Salts for keys that are hot in this task: 0 for the first ``GROUP`` + 1 rows of a key, others beyond.

    So a key has salted rows only where its unsalted ones are too many to list.
    """

    def __init__(self, most: int) -> None:
        self.most, self.hot = most, np.zeros(0, np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        salt = np.zeros(len(keys), np.int32)
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        at = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.r_[at, len(keys)])
        known = np.isin(sorted_keys[at], self.hot)
        for s, g, k in zip(at[(size > self.most) | known], size[(size > self.most) | known], known[(size > self.most) | known]):
            place = np.arange(g) + (self.most + 1 if k else 0)
            salt[order[s : s + g]] = np.where(place > self.most, 1 + (mix(order[s : s + g].astype(np.uint64)) % np.uint64(1 << 20)).astype(np.int64), 0)
        self.hot = np.union1d(self.hot, sorted_keys[at[size > self.most]])
        return salt


def _plan(low: np.ndarray, exact: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For bands of sets of ``low`` to twice as many runs: blocks, share of the universe used, least runs in a block.

    Two sets of such a band that are as near as ``exact`` differ in at most
    (1 - exact) / (1 + exact) of all their runs, so two more blocks than that
    leave two of them equal.
    """
    if exact is not None:
        return (4 * low * (1 - exact) / (1 + exact)).astype(np.int64) + 3, np.ones(len(low)), np.zeros(len(low), np.int64)
    blocks = np.select([low >= 256, low >= 128, low >= 64], [96, 64, 48], 32)
    share = np.where(low >= 256, np.minimum(1.0, 240 / np.maximum(low, 1)), 1.0)
    least = np.select([low >= 256, low >= 128], [3, 2], 1)
    return blocks, share, least


def _sketch_keys(hashes: np.ndarray, ends: np.ndarray, low: np.ndarray, picked: np.ndarray, exact: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the usable blocks of the picked sets in the bands that begin at ``low``; and the set of each."""
    blocks, share, least = _plan(low, exact)
    starts = np.r_[0, ends[:-1]]
    of = np.repeat(np.arange(len(ends)), ends - starts)
    scale = blocks / share / 2.0**53
    block = ((hashes >> np.uint64(11)).astype(np.float64) * scale[of]).astype(np.int64)
    use = (block < blocks[of]) & picked[of]
    of, block, h = of[use], block[use], hashes[use]
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    new = np.r_[True, (of[1:] != of[:-1]) | (block[1:] != block[:-1])]
    at = np.flatnonzero(new)
    word = np.bitwise_xor.reduceat(mix(h + np.uint64(0xD6E8FEB86659FD93)), at)
    count = np.diff(np.r_[at, len(h)])
    of, block = of[at], block[at]
    tag = mix(mix(low[of].astype(np.uint64)) + block.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + count.astype(np.uint64))
    use = count >= least[of]
    keys, of = mix(word ^ tag)[use], of[use]
    small = low[of] <= 16
    return np.concatenate([keys, mix(keys[small])]), np.concatenate([of, of[small]])


def _block_keys(texts: DataFrame, threshold: float, exact: bool) -> DataFrame:
    """(k, s, d): one row per class and usable block, with its salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salter = Salter(GROUP)
        for d, texts in first_of_partition(batches):
            hashes, ends = run_sets(texts)
            n = np.diff(np.r_[0, ends])
            low = 1 << np.floor(np.log2(n)).astype(np.int64)
            for band, picked in ((low, np.ones(len(n), bool)), (low // 2, (n * threshold < low) & (low > 1))):
                keys, of = _sketch_keys(hashes, ends, band, picked, threshold if exact else None)
                keys = keys.view(np.int64)
                yield pa.record_batch([pa.array(keys), pa.array(salter(keys)), pa.array(d[of])], names=["k", "s", "d"])

    return texts.select("h1", "text").mapInArrow(run, "k bigint, s int, d bigint")


def grouped(batches: Iterator[pa.RecordBatch], most: int = 65_536) -> Iterator[tuple[list[np.ndarray], int]]:
    """Columns of sorted rows in chunks that end where the first column changes, and -1.

    Rows of one key beyond ``most`` come in chunks of their own with the number
    of rows of that key before them, so no key is held whole.
    """
    rest: list[np.ndarray] | None = None
    base = 0
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            now = [np.concatenate([a, b]) for a, b in zip(rest, now)]
        if base and len(now[0]):  # the key that overflowed goes on
            same = int(np.argmax(now[0] != over)) if (now[0] != over).any() else len(now[0])
            if same:
                yield [c[:same] for c in now], base
                base += same
            now = [c[same:] for c in now]
            if len(now[0]):
                base = 0
        if not len(now[0]):
            rest = now
            continue
        other = np.flatnonzero(now[0] != now[0][-1])
        split = int(other[-1]) + 1 if len(other) else 0
        if split:
            yield [c[:split] for c in now], -1
        rest = [c[split:] for c in now]
        if len(rest[0]) > most:
            yield rest, 0
            base, over, rest = len(rest[0]), rest[0][-1], None
    if rest is not None and len(rest[0]):
        yield rest, -1


def _pairs(rows: DataFrame) -> DataFrame:
    """(a, b, hot): pairs of classes under one key; members (key, class) of groups too large to list are hot."""

    def emit(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, s, d), base in grouped(batches):
            new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]
            k, s, d = k[new], s[new], d[new]
            if base >= 0:
                yield emit(k, d, True)
                continue
            if s.any():
                yield emit(k[s > 0], d[s > 0], True)
                k, d = k[s == 0], d[s == 0]
                if not len(k):
                    continue
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[at, len(k)])
            for g in np.unique(size[(size > 1) & (size <= GROUP)]):
                table = d[at[size == g][:, None] + np.arange(g)]
                i, j = np.triu_indices(g, 1)
                step = max(1, 400_000 // len(i))
                for p in range(0, len(table), step):
                    yield emit(table[p : p + step, i].ravel(), table[p : p + step, j].ravel(), False)
            for p, g in zip(at[size > GROUP], size[size > GROUP]):
                yield emit(k[p : p + g], d[p : p + g], True)

    return rows.repartition("k", "s").sortWithinPartitions("k", "s", "d").mapInArrow(run, "a bigint, b bigint, hot boolean")


def _bit_sketches(texts: DataFrame) -> DataFrame:
    """(d, n, bits) of (h1, text) rows: number of runs, and the parity of the runs that fall on each bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, texts in first_of_partition(batches):
            hashes, ends = run_sets(texts)
            starts = np.r_[0, ends[:-1]]
            of = np.repeat(np.arange(len(ends)), ends - starts)
            odd = np.bincount(of * SKETCH_BITS + (hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=len(ends) * SKETCH_BITS) & 1
            bits = np.packbits(odd.astype(np.uint8).reshape(len(ends), SKETCH_BITS), axis=1)
            yield pa.record_batch([pa.array(d), pa.array(ends - starts), pa.array([r.tobytes() for r in bits], pa.binary())], names=["d", "n", "bits"])

    return texts.select("h1", "text").mapInArrow(run, "d bigint, n bigint, bits binary").dropDuplicates(["d"])


def tiled(hot: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of classes of one hot key within the Hamming bound, compared tile by tile.

    ``hot`` has (k, d), ``sketches`` (d, n, bits).
    """
    share = (1 - threshold) / (1 + threshold)

    def compare(group: pa.Table) -> pa.Table:
        d, n, tile = (group.column(c).to_numpy() for c in ("d", "n", "tile"))
        bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        left, right = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
        found = []
        for i in left:
            others = right[right > i] if lo == hi else right
            others = others[np.minimum(n[others], n[i]) >= threshold * np.maximum(n[others], n[i]) - 1e-9]
            apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1)
            near = others[apart <= share * (n[others] + n[i]) + 1e-9]
            found.append(np.stack([np.full(len(near), i), near]))
        i, j = np.concatenate(found, axis=1).astype(np.int64) if found else np.zeros((2, 0), np.int64)
        i, j = np.where(d[i] < d[j], i, j), np.where(d[i] < d[j], j, i)
        return pa.table({"a": d[i], "b": d[j]})

    hot = hot.select("k", "d").distinct()
    tiles = hot.groupBy("k").agg(F.ceil(F.count("*") / TILE).cast("bigint").alias("tiles"))
    sketched = hot.join(sketches, "d").join(tiles, "k").withColumn("tile", F.pmod(F.xxhash64("d", "k"), "tiles"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("o")
    columns = ["k", "d", "n", "bits", "tile"]
    spread = sketched.select(*columns, other).select(*columns, F.least("tile", "o").alias("lo"), F.greatest("tile", "o").alias("hi"))
    return spread.groupBy("k", "lo", "hi").applyInArrow(compare, "a bigint, b bigint")


def sketch_candidates(texts: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(a, b): digests of classes that may be near; ``texts`` as from ``prepared``, ``classes`` has (d, rep)."""
    rows = stage(_pairs(_block_keys(texts, threshold, exact)), "sketch-pairs")
    pairs = rows.where("not hot").groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    hot = rows.where("hot").select(F.col("a").alias("k"), F.col("b").alias("d"))
    if not hot.isEmpty():
        ids = classes.join(hot.select("d").distinct(), "d", "left_semi").select(F.col("rep").alias("id"))
        pairs = pairs.unionByName(tiled(hot, _bit_sketches(picked(texts, ids)), threshold)).distinct()
    return pairs


def picked(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` with these distinct ids; a list of checked size is broadcast."""
    ids = stage(ids, "ids")
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def starting(points: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` characters from each place on."""
    h = np.zeros(len(points) - length + 1, np.uint64)
    for j in range(length):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[j : j + len(h)]
    return mix(h)


def covered(a: str, b: str, shifts: list[int] | None, least: int) -> tuple[int, int]:
    """Characters of ``a`` and of ``b`` in common spans of at least ``least`` characters on these diagonals (place in a - place in b), on all if None."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    if shifts is None:
        least = min(least, len(x), len(y))
        if not least:
            return 0, 0
        p, q = starting(x, least), starting(y, least)
        in_x, in_y = (np.convolve(np.isin(u, v), np.ones(least, np.int32)) for u, v in ((p, q), (q, p)))
        return int((in_x > 0).sum()), int((in_y > 0).sum())
    in_x, in_y = np.zeros(len(x) + 1, np.int32), np.zeros(len(y) + 1, np.int32)
    for g in shifts:
        lo, hi = max(0, g), min(len(x), len(y) + g)
        if hi <= lo:
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, x[lo:hi] == y[lo - g : hi - g], False].astype(np.int8)))
        start, end = edge[::2] + lo, edge[1::2] + lo
        use = end - start >= min(least, len(x), len(y))
        np.add.at(in_x, start[use], 1)
        np.add.at(in_x, end[use], -1)
        np.add.at(in_y, start[use] - g, 1)
        np.add.at(in_y, end[use] - g, -1)
    return int((np.cumsum(in_x) > 0).sum()), int((np.cumsum(in_y) > 0).sum())


def verified(texts: DataFrame, pairs: DataFrame, threshold: float, least: int) -> DataFrame:
    """(u, v, shared, n_u, n_v, share_u, share_v) of the pairs of ids (u, v, their digests a, b) whose texts are near.

    Shares are those of either text's characters in common spans of ``least``
    characters or more, at any place; 0 where ``least`` is.
    """
    pairs = stage(pairs, "pairs")
    ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    some = picked(texts.select("id", "h1", "text"), ids)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * 2_000_000 // max(1, batch.nbytes))
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                shared, n_u, n_v = jaccard(pa.concat_arrays([part.column(2)]), pa.concat_arrays([part.column(3)]))
                near = pa.array(shared >= threshold * (n_u + n_v - shared) - 1e-9)
                columns = [part.column(0), part.column(1), pa.array(shared), pa.array(n_u), pa.array(n_v)]
                found = pa.record_batch([*columns, *part.columns[2:]], names=["u", "v", "shared", "n_u", "n_v", "a", "b"]).filter(near)
                shares = [(x / len(a), y / len(b)) for a, b in zip(found.column("a").to_pylist(), found.column("b").to_pylist()) for x, y in [covered(a, b, None, least)]]
                share_u, share_v = (pa.array([r[i] for r in shares], pa.float64()) for i in (0, 1))
                yield pa.record_batch([*found.columns[:5], share_u, share_v], names=["u", "v", "shared", "n_u", "n_v", "share_u", "share_v"])

    left = some.select(F.col("id").alias("u"), F.col("h1").alias("a"), F.col("text").alias("text_a"))
    right = some.select(F.col("id").alias("v"), F.col("h1").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, ["u", "a"]).join(right, ["v", "b"]).select("u", "v", "text_a", "text_b")
    return both.mapInArrow(check, "u bigint, v bigint, shared bigint, n_u bigint, n_v bigint, share_u double, share_v double").distinct()


def linked(
    docs: DataFrame, candidates: Callable[[DataFrame, DataFrame, float], DataFrame], threshold: float = THRESHOLD, least: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(id, grp, rep) of every row with a text, and the links (u, v, …) between class representatives (see ``verified``).

    ``candidates`` gives (a, b), the digests of two classes.
    """
    texts = prepared(docs)
    classes = texts.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    by_digest = classes.select(F.col("h1").alias("d"), "rep")
    pairs = candidates(texts, by_digest, threshold)
    pairs = pairs.join(by_digest.select(F.col("d").alias("a"), F.col("rep").alias("x")), "a").join(by_digest.select(F.col("d").alias("b"), F.col("rep").alias("y")), "b")
    pairs = pairs.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), F.when(F.col("x") < F.col("y"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("x") < F.col("y"), F.col("b")).otherwise(F.col("a")).alias("b"))
    links = stage(verified(texts, pairs, threshold, least), "links")
    joined = components(links.select("u", "v"))
    reps = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "rep", F.coalesce("component", "rep").alias("grp"))
    return texts.select("id", "h1", "h2").join(reps, ["h1", "h2"]).select("id", "grp", "rep").distinct(), links


def near_groups(df: DataFrame, key: str = "row_id", text: str = "text", threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(key, group_id, n_links): the group of every row with a text, and the links of its text to others."""
    rows, links = linked(documents(df, key, text), partial(sketch_candidates, exact=exact), threshold)
    ends = links.select(F.col("u").alias("rep")).unionByName(links.select(F.col("v").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    return rows.join(ends, "rep", "left").select(F.col("id").alias(key), F.col("grp").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def group_pairs(rows: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b, grp): all pairs of rows of one group, as the result form demands."""
    shared = rows.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
    some = stage(rows.select("id", "grp").join(shared, "grp", "left_semi"), "grouped")
    return some.select("grp", F.col("id").alias("row_id_a")).join(some.select("grp", F.col("id").alias("row_id_b")), "grp").where("row_id_a < row_id_b").select("row_id_a", "row_id_b", "grp")


def near_pairs(df: DataFrame, key: str = "row_id", text: str = "text", threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(row_id_a, row_id_b) of all rows of one group."""
    rows, _ = linked(documents(df, key, text), partial(sketch_candidates, exact=exact), threshold)
    return group_pairs(rows).select("row_id_a", "row_id_b")
