"""Records of evaluation splits that also stand in training (problem 1).

Two records overlap where the sets of all runs of five characters of their texts
share 0.7 of their union, or through a third record. Candidates come from an
ordered index of the runs, in which no such pair can be missed:

1. All runs of all texts are counted into ``CELLS`` cells. This puts the runs
   into one order for all texts, rare ones first; cells shared by several runs
   change the order, not the result.
2. A set of n runs is near another only if they share ceil(0.7 n) of them. Its
   first n - ceil(0.7 n) + 1 runs in that order are one more than may be missing,
   so one of them is shared, and the first run that two near texts share is
   among these of both. Each goes to the partition of its hash, packed by text.
3. Texts meet under each run. A pair is dropped only where its sizes, or the
   runs that are left behind this one in either text, leave too few to share, or
   where bit sketches of the two sets are too far apart by the Hamming bound.
   Runs of more than ``GROUP`` texts are compared in square tiles.

Every place of a text is in its set, and no step depends on chance or on the
kind of the edits. ``all_runs`` puts every run into the index, to compare with.

The exact check (see ``neardup``) takes the whole texts. It also finds all spans
of ``SPAN`` characters or more that the two have in common, at every place, and
merges them into the share of either record that they cover. Near pairs are
joined into groups, since two records also overlap through a third one; for
this, pairs within a split are needed as well.

Results: null, empty and blank texts overlap with nothing; equal texts always
do; a null split counts as not train; rows repeated under one key stay one row;
other columns, whatever their names, are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyarrow.dataset import dataset
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.grams import mix, run_sets
from vellum.llm.neardup import THRESHOLD, _bit_sketches, documents, first_of_partition, linked, picked, tiled
from vellum.plans.staging import stage

#: Least length of a common span that counts as covered.
SPAN = 16
#: Largest number of texts under one run that are compared in its task; more go in tiles.
GROUP = 2_048
#: Least bits of a sketch (a power of two, 64 or more).
LEAST_BITS = 1_024
#: Most sketches (some 150 bytes each) that a worker reads from the shared folder; beyond it pairs are joined with them.
KEPT_SKETCHES = 3_000_000
#: Cells in which runs are counted (a power of two), and parts in which the counts are added up.
CELLS, PARTS = 1 << 20, 64
#: Rows of the index in one partition; their number grows with the runs, so that a task's memory doesn't.
ROWS = 2_000_000


def rarity(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Level of each cell, a logarithm of the runs counted in it; and the number of all runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for _, part in first_of_partition(batches):
            cells += np.bincount(_cell(run_sets(part)[0]), minlength=CELLS)
        if cells.any():
            yield pa.record_batch([pa.array(np.arange(PARTS)), pa.array([c.astype(np.uint32).tobytes() for c in np.split(cells, PARTS)], pa.binary())], names=["part", "cells"])

    def add(group: pa.Table) -> pa.Table:
        cells = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in group.column("cells").to_pylist())
        levels = np.minimum(255, 6 * np.log2(1 + cells)).astype(np.uint8)
        return pa.table({"part": group.column("part")[:1], "levels": pa.array([levels.tobytes()], pa.binary()), "runs": [int(cells.sum())]})

    counted = texts.select("h1", "text").mapInArrow(count, "part bigint, cells binary")
    rows = counted.groupBy("part").applyInArrow(add, "part bigint, levels binary, runs bigint").collect()
    return np.frombuffer(b"".join(bytes(r.levels) for r in sorted(rows, key=lambda r: r.part)), np.uint8), sum(r.runs for r in rows)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(65 - CELLS.bit_length())).astype(np.int64)


def rare_first(texts: pa.Array, levels: np.ndarray, threshold: float = THRESHOLD, all_runs: bool = False) -> tuple[np.ndarray, ...]:
    """(text, run, its place in the order) of the runs that go into the index, by text; and the number of runs of each text."""
    hashes, ends = run_sets(texts)
    starts = np.r_[0, ends[:-1]]
    n = ends - starts
    order = levels[_cell(hashes)].astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8)
    for a, b in zip(starts, ends):
        order[a:b].sort()
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(order)) - starts[of]
    if not all_runs:
        use = place < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[of]
        of, order, place = of[use], order[use], place[use]
    return of, mix(order), place, n


def _index(texts: DataFrame, levels: np.ndarray, partitions: int, threshold: float, all_runs: bool) -> DataFrame:
    """(p, runs, places, d, n, counts): per partition and task, runs and places by text; class, runs and number of rows of each text."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, part in first_of_partition(batches):
            of, key, place, n = rare_first(part, shared.value, threshold, all_runs)
            p = ((key >> np.uint64(32)) % np.uint64(partitions)).astype(np.int32)
            to = np.argsort(p, kind="stable")
            p, of = p[to], of[to]
            # a place beyond 65 535 counts as that: fewer pairs are dropped then
            key, place = key[to].astype(np.uint32), np.minimum(place[to], 65_535).astype(np.uint16)
            new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (of[1:] != of[:-1])])
            counts, text, own = np.diff(np.r_[new, len(p)]).astype(np.int32), of[new], p[new]
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            rows, heads = np.r_[new[at], len(p)], np.r_[at, len(own)]
            packed = [[c[a:b].tobytes() for a, b in zip(e[:-1], e[1:])] for c, e in ((key, rows), (place, rows), (d[text], heads), (n[text].astype(np.int32), heads), (counts, heads))]
            yield pa.record_batch([pa.array(own[at]), *(pa.array(c, pa.binary()) for c in packed)], names=["p", "runs", "places", "d", "n", "counts"])

    return texts.select("h1", "text").mapInArrow(run, "p int, runs binary, places binary, d binary, n binary, counts binary")


def sketched(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Runs of each text, and the parity of the runs that fall on each bit of its sketch, which has a bit or more for each run."""
    hashes, ends = run_sets(texts)
    n = np.diff(np.r_[0, ends])
    bits = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(n)).astype(np.int64))
    first = np.r_[0, np.cumsum(bits)]
    odd = np.bincount(np.repeat(first[:-1], n) + (hashes & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64), minlength=first[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return n, [packed[a:b] for a, b in zip(first[:-1] // 8, first[1:] // 8)]


def _sketches_of(texts: DataFrame) -> DataFrame:
    """(d, n, bits) of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, part in first_of_partition(batches):
            n, bits = sketched(part)
            yield pa.record_batch([pa.array(d), pa.array(n), pa.array(bits, pa.binary())], names=["d", "n", "bits"])

    return texts.select("h1", "text").mapInArrow(run, "d bigint, n bigint, bits binary").dropDuplicates(["d"])


def _words(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sketches as words, and where each begins and how many it has."""
    size = np.array([len(x) // 8 for x in sketches], np.int64)
    return np.frombuffer(b"".join(sketches), np.uint64), np.cumsum(size) - size, size


@lru_cache(maxsize=1)
def _read_sketches(path: str) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Classes in order and their sketches, as staged in a folder; read once by a worker."""
    files, folder = FileSystem.from_uri(path)
    table = dataset(folder, format="parquet", filesystem=files).to_table(columns=["d", "bits"]).sort_by("d")
    return table.column("d").to_numpy(), _words(table.column("bits").to_pylist())


def apart(words: np.ndarray, first: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the sketches i and j differ, the larger one folded to the size of the other: no more than the runs in which the sets do."""
    out = np.zeros(len(i), np.int64)
    shape = size[i] << 32 | size[j]
    for both in np.unique(shape):
        of, u, v = np.flatnonzero(shape == both), int(both >> 32), int(both & 0xFFFFFFFF)
        step = max(1, 4_000_000 // (u + v))
        for s in range(0, len(of), step):
            at = of[s : s + step]
            x, y = words[first[i[at]][:, None] + np.arange(u)], words[first[j[at]][:, None] + np.arange(v)]
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            out[at] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def _met(index: DataFrame, partitions: int, threshold: float, path: str | None) -> DataFrame:
    """(a, b, hot): pairs of classes under runs of up to ``GROUP`` of them; members (run, class) of larger ones are hot.

    With the ``path`` of sketches, pairs beyond the Hamming bound are dropped.
    """
    share = (1 - threshold) / (1 + threshold)

    def emit(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: list[list[bytes]] = [[], [], [], [], []]
        p = 0
        for batch in batches:
            for kept, column in zip(read, batch.columns[1:]):
                kept += column.to_pylist()
            p = batch.column(0)[0].as_py()
        key, place, d, n, counts = (np.frombuffer(b"".join(c), t) for c, t in zip(read, (np.uint32, np.uint16, np.int64, np.int32, np.int32)))
        if not len(key):
            return
        read.clear()
        d, first, text = np.unique(d, return_index=True, return_inverse=True)
        n, text = n[first].astype(np.int64), np.repeat(text, counts)
        _, first = np.unique(key.astype(np.uint64) << np.uint64(32) | text.astype(np.uint64), return_index=True)
        key, text, place = key[first].astype(np.int64), text[first], place[first].astype(np.int64)
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[at, len(key)])
        large = np.repeat(size > GROUP, size)
        yield emit(key[large] | p << 32, d[text[large]], hot=True)
        some = np.repeat((size > 1) & (size <= GROUP), size)
        key, text, place = key[some], text[some], place[some]
        # behind the first run that they share, either text must have enough left: so a partner has at most ``most`` runs
        most = np.floor((n[text] - place) / (threshold / (1 + threshold)) - n[text] + 1e-6).astype(np.int64)
        order = np.lexsort((n[text], key))
        key, text, most = key[order], text[order], most[order]
        by_size = key.astype(np.uint64) << np.uint64(32) | n[text].astype(np.uint64)
        x = np.flatnonzero(most >= n[text])
        end = np.searchsorted(by_size, key[x].astype(np.uint64) << np.uint64(32) | most[x].astype(np.uint64), side="right")
        partners = end - x - 1
        x, partners = x[partners > 0], partners[partners > 0]
        if not len(x):
            return
        if path:
            known, (words, begin, length) = _read_sketches(path)
            own = np.searchsorted(known, d)
            begin, length = begin[own], length[own]
        part = np.cumsum(partners) // 500_000
        for c in np.split(np.arange(len(x)), np.flatnonzero(part[1:] != part[:-1]) + 1):
            i = np.repeat(x[c], partners[c])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(partners[c]) - partners[c], partners[c])
            use = n[text[i]] <= most[j]
            i, j = text[i[use]], text[j[use]]
            found = np.unique(np.minimum(i, j) << 32 | np.maximum(i, j))
            i, j = found >> 32, found & 0xFFFFFFFF
            if path:
                use = apart(words, begin, length, i, j) <= share * (n[i] + n[j]) + 1e-9
                i, j = i[use], j[use]
            yield emit(d[i], d[j], hot=False)

    return index.repartitionById(partitions, "p").mapInArrow(run, "a bigint, b bigint, hot boolean")


def _within_bound(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) within the Hamming bound, by joins."""
    share = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = _words(batch.column("bits").to_pylist() + batch.column("bits_b").to_pylist())
            i = np.arange(batch.num_rows)
            most = share * (batch.column("n").to_numpy() + batch.column("n_b").to_numpy()) + 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(apart(*sketches, i, i + len(i)) <= most))

    other = sketches.select(F.col("d").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    return pairs.join(sketches.withColumnRenamed("d", "a"), "a").join(other, "b").mapInArrow(run, "a bigint, b bigint")


def rare_candidates(texts: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, all_runs: bool = False) -> DataFrame:
    """(a, b) of the classes that share a run of the index and may be near by their sizes and sketches."""
    levels, runs = rarity(texts)
    partitions = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(runs * (1 if all_runs else 1 - threshold)) // ROWS + 1)
    sketches = stage(_sketches_of(texts), "sketches")
    files = sketches.inputFiles()
    path = files[0].rpartition("/")[0] if files and sketches.count() <= KEPT_SKETCHES else None
    rows = stage(_met(_index(texts, levels, partitions, threshold, all_runs), partitions, threshold, path), "met")
    pairs = rows.where("not hot").select("a", "b").distinct()
    if not path:
        pairs = _within_bound(pairs, sketches, threshold)
    hot = rows.where("hot").select(F.col("a").alias("k"), F.col("b").alias("d"))
    if not hot.isEmpty():
        ids = classes.join(hot.select("d").distinct(), "d", "left_semi").select(F.col("rep").alias("id"))
        pairs = pairs.unionByName(tiled(hot, _bit_sketches(picked(texts, ids)), threshold)).distinct()
    return pairs


def _with_split(df: DataFrame, key: str, text: str, split: str, *others: str, all_suffixes: bool = False) -> tuple[DataFrame, DataFrame]:
    rows, links = linked(documents(df, key, text), partial(rare_candidates, all_runs=all_suffixes), least=SPAN)
    splits = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(split) == "train", F.lit(False)).alias("train"), F.col(split).alias("split"), *others).dropDuplicates(["id"])
    return splits.join(rows, "id", "left"), links


def cross_pairs(df: DataFrame, key: str = "row_id", text: str = "text", split: str = "split", all_suffixes: bool = False) -> DataFrame:
    """(row_id_a, row_id_b) of all rows of one group of which exactly one is in train; ``all_suffixes`` puts every run into the index."""
    rows, _ = _with_split(df, key, text, split, all_suffixes=all_suffixes)
    kept = stage(rows.where("grp is not null").select("id", "grp", "train"), "cross")
    both = kept.groupBy("grp").agg(F.max("train").alias("x"), F.min("train").alias("y")).where("x and not y").select("grp")
    some = kept.join(both, "grp", "left_semi")
    pairs = some.where("train").select("grp", F.col("id").alias("t")).join(some.where("not train").select("grp", F.col("id").alias("o")), "grp")
    return pairs.select(F.least("t", "o").alias("row_id_a"), F.greatest("t", "o").alias("row_id_b"))


def overlap_rows(df: DataFrame, key: str = "row_id", text: str = "text", split: str = "split", source: str = "source") -> DataFrame:
    """(id, split, source, overlaps, equal, covered) of every row outside train.

    ``covered`` is the largest share of its characters in common spans with one
    text of train: 1 for an equal text, 0 where the group reaches train only
    through a third record.
    """
    rows, links = _with_split(df, key, text, split, F.col(source).alias("source"))
    rows = stage(rows, "overlap")
    groups = rows.where("train and grp is not null").select("grp").distinct().withColumn("near", F.lit(True))
    texts = stage(rows.where("train and rep is not null").select("rep").distinct(), "train-texts")
    sides = links.select(F.col("u").alias("rep"), F.col("v").alias("other"), F.col("share_u").alias("share"))
    sides = sides.unionByName(links.select(F.col("v").alias("rep"), F.col("u").alias("other"), F.col("share_v").alias("share")))
    cover = sides.join(texts.select(F.col("rep").alias("other")), "other").groupBy("rep").agg(F.max("share").alias("share"))
    held = rows.where("not train").join(groups, "grp", "left").join(texts.withColumn("same", F.lit(True)), "rep", "left").join(cover, "rep", "left")
    equal, near = F.coalesce("same", F.lit(False)), F.coalesce("near", F.lit(False))
    return held.select("id", "split", "source", near.alias("overlaps"), equal.alias("equal"), F.when(equal, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("covered"))


def overlap_report(df: DataFrame, key: str = "row_id", text: str = "text", split: str = "split", source: str = "source") -> DataFrame:
    """Per split and source outside train: rows, rows that overlap with train, those with an equal text there, and the mean covered share of those that overlap."""
    rows = overlap_rows(df, key, text, split, source)
    return rows.groupBy("split", "source").agg(
        F.count("*").alias("n_rows"), F.count_if("overlaps").alias("n_overlap"), F.count_if("equal").alias("n_equal"),
        F.avg(F.col("overlaps").cast("double")).alias("overlap_rate"), F.avg(F.when(F.col("overlaps"), F.col("covered"))).alias("covered_share"),
    ).withColumnRenamed("source", source)
