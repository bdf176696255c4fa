"""Example pools and scored retrieval of examples for a text.

A set of queries is ranked against a whole pool in blocks: a chunk of the pool
and a block of the queries meet in one task, so neither is broadcast and no pair
of texts becomes a row. In a task, an index over the chunk (an automaton of all
its names, triggers and keywords, and lists of the examples of each bigram)
gives the hits and similarities of a query with all examples at once. Of these
only rows that can still be chosen leave the task: the best ``n`` and the best of
each combination of event types, which is all that the greedy choice can use.
Every pair is scored; nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.text import keywords, retrieval_form, strip
from vellum.operators.arguments import event_type_list

#: Longest value that serves as a keyword.
KEYWORD = 12
#: Examples in a chunk of the pool and queries in a block: what one task holds.
CHUNK, BLOCK = 8_000, 2_000


def example_pool(df: DataFrame, key: str = "row_id", text: str = "text", events: str = "events") -> DataFrame:
    """(id, text, event_types, triggers, roles, keywords) of rows with events."""
    real = F.filter(events, lambda e: e.isNotNull())
    some = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != ""))
    args = F.flatten(F.transform(F.filter(real, lambda e: e["arguments"].isNotNull()), lambda e: F.filter(e["arguments"], lambda a: a.isNotNull())))
    rows = df.where(F.size(events) > 0).select(
        F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"), event_type_list(F.col(events)).alias("event_types"),
        some(F.transform(real, lambda e: e["trigger"])).alias("triggers"), some(F.transform(args, lambda a: a["role"])).alias("roles"), some(F.transform(args, lambda a: a["argument"])).alias("values"),
    )
    words = F.array_distinct(F.concat("event_types", "triggers", F.filter("values", lambda v: F.char_length(v) <= KEYWORD)))
    return rows.where(F.size("event_types") > 0).select("id", "text", "event_types", "triggers", "roles", words.alias("keywords"))


def named_types(text: Column, types: list[str], cues: dict[str, list[str]] | None = None) -> Column:
    """Types of a list that stand in a text themselves or by a cue."""
    out = F.array(*[F.when(F.array_contains(F.transform(F.array(*[F.lit(c) for c in [t, *(cues or {}).get(t, [])]]), lambda c: text.contains(c)), True), F.lit(t)) for t in types])
    return F.filter(out, lambda t: t.isNotNull())


def bigrams(form: str) -> np.ndarray:
    """Distinct bigrams of a retrieval form as numbers; one character is its own only one."""
    cp = np.frombuffer(form.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique((cp[:-1] << 21) | cp[1:] if len(cp) > 1 else cp)


class Postings:
    """Which examples have which of a number of names."""

    def __init__(self, lists: list[list[str]]) -> None:
        self.names: dict[str, int] = {}
        owner, name = [], []
        for i, values in enumerate(lists):
            for v in dict.fromkeys(values):
                owner.append(i)
                name.append(self.names.setdefault(v, len(self.names)))
        order = np.argsort(np.array(name, np.int64), kind="stable")
        self.owner = np.array(owner, np.int64)[order]
        self.ends = np.cumsum(np.bincount(np.array(name, np.int64), minlength=len(self.names))) if name else np.zeros(0, np.int64)
        self.size = len(lists)

    def hits(self, names: Iterator[str]) -> np.ndarray:
        """How many of the names each example has."""
        at = [self.names[n] for n in names if n in self.names]
        if not at:
            return np.zeros(self.size, np.int64)
        return np.bincount(np.concatenate([self.owner[self.ends[i - 1] if i else 0 : self.ends[i]] for i in at]), minlength=self.size)


class Chunk:
    """Index over a chunk of the pool."""

    def __init__(self, pool: pa.Table, schema: set[str]) -> None:
        import ahocorasick

        columns = {c: pool.column(c).to_pylist() for c in ("event_types", "triggers", "roles", "keywords")}
        self.ids, self.length = pool.column("id").to_numpy(), pool.column("length").to_numpy()
        self.types, self.triggers, self.roles, self.words = (Postings(columns[c]) for c in ("event_types", "triggers", "roles", "keywords"))
        self.in_schema = Postings([[t for t in ts if t in schema] for ts in columns["event_types"]])
        self.n_types = np.array([len(set(ts)) for ts in columns["event_types"]], np.int64)
        self.lists = columns["event_types"]
        kinds: dict[tuple, int] = {}
        self.kind = np.array([kinds.setdefault(tuple(sorted(set(ts))), len(kinds)) for ts in self.lists], np.int64)
        grams = [bigrams(f or "") for f in pool.column("form").to_pylist()]
        self.n_grams = np.array([len(g) for g in grams], np.int64)
        flat, owner = np.concatenate([np.zeros(0, np.int64), *grams]), np.repeat(np.arange(len(grams)), self.n_grams)
        order = np.argsort(flat, kind="stable")
        self.grams, self.owner = flat[order], owner[order]
        self.automaton = ahocorasick.Automaton()
        for name in {*self.types.names, *self.triggers.names, *self.words.names}:
            self.automaton.add_word(name, name)
        self.automaton.make_automaton()

    def similarity(self, form: str) -> np.ndarray:
        """Share of the union of bigrams that a query and each example have in common."""
        own = bigrams(form)
        lo, hi = np.searchsorted(self.grams, own, "left"), np.searchsorted(self.grams, own, "right")
        some = [self.owner[a:b] for a, b in zip(lo, hi) if b > a]
        shared = np.bincount(np.concatenate(some), minlength=len(self.ids)) if some else np.zeros(len(self.ids), np.int64)
        return np.where((shared > 0) & (len(own) > 0), shared / np.maximum(1, self.n_grams + len(own) - shared), 0.0)

    def best(self, qid: int, text: str, form: str, types: list[str], words: list[str], constrained: bool, n: int) -> dict[str, np.ndarray]:
        """Rows of this chunk that can be among the chosen of a query: the first ``n``, and the first of each combination of types."""
        found = {name for _, name in self.automaton.iter(text)} if len(self.automaton) else set()
        overlap = self.types.hits(dict.fromkeys(types))
        keep = (self.ids != qid) & ((overlap > 0) if constrained else True)
        type_hits, trigger_hits, word_hits, schema_hits = (p.hits(found) for p in (self.types, self.triggers, self.words, self.in_schema))
        role_hits, near = self.roles.hits(dict.fromkeys(words)), self.similarity(form)
        score = np.round(12.0 * type_hits + 7.0 * trigger_hits + 3.0 * word_hits + 2.0 * schema_hits + 1.5 * role_hits + 6.0 * near - 0.002 * self.length, 9)
        extra = self.n_types - overlap if types else np.zeros(len(self.ids), np.int64)
        focused = (overlap > 0) & (extra == 0)
        single = focused & (len(set(types)) == 1)
        at = np.flatnonzero(keep)
        keys = (self.ids, word_hits + role_hits, trigger_hits, type_hits, near, score, -extra, overlap, focused, single)
        at = at[np.lexsort([k[at] for k in keys])[::-1]]
        first = np.unique(self.kind[at], return_index=True)[1]
        at = at[np.unique(np.concatenate([np.arange(min(n, len(at))), first]))]
        columns = {"single": single.astype(np.int32), "focused": focused.astype(np.int32), "overlap": overlap, "extra": extra, "score": score, "similarity": near}
        columns |= {"type_hits": type_hits, "trigger_hits": trigger_hits, "word_hits": word_hits + role_hits, "id": self.ids}
        return {c: v[at] for c, v in columns.items()} | {"event_types": [self.lists[i] for i in at]}


_FIELDS = "qid bigint, single int, focused int, overlap bigint, extra bigint, score double, similarity double, type_hits bigint, trigger_hits bigint, word_hits bigint, id bigint, event_types array<string>"
_ORDER = ("single", "focused", "overlap", "-extra", "score", "similarity", "type_hits", "trigger_hits", "word_hits", "id")


def ranked(queries: DataFrame, pool: DataFrame, n: int = 3, schema: list[str] = (), chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(qid, place, id, score, …) of the examples that can be among the chosen ``n`` of each query (qid, text, types), best first.

    A query with types is ranked against the examples that share one of them, or
    against all where no other example does; an example is none for itself. Null
    texts count as empty, null types as none. ``schema``: the known types, whose
    names in a text count once more.
    """
    empty = F.array().cast("array<string>")
    names = pool.select("id", F.explode("event_types").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    book = names.agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))))  # as many entries as types
    own = pool.select(F.col("id").alias("qid"), F.col("event_types").alias("own"))
    q = queries.select(F.col("qid").cast("bigint").alias("qid"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("types", empty).alias("types")).join(own, "qid", "left").withColumn("book", book.scalar())
    others = lambda t: F.coalesce(F.element_at("book", t), F.lit(0)) - F.when(F.array_contains(F.coalesce("own", empty), t), 1).otherwise(0)
    q = q.select("qid", "text", retrieval_form(F.col("text")).alias("form"), "types", keywords(F.col("text")).alias("words"), F.exists("types", lambda t: others(t) > 0).alias("constrained"))
    p = pool.select(F.col("id").cast("bigint").alias("id"), F.char_length("text").cast("double").alias("length"), retrieval_form(F.col("text")).alias("form"), "event_types", "triggers", "roles", "keywords")
    n_chunks, n_blocks = (max(1, -(-df.count() // size)) for df, size in ((pool, chunk), (queries, block)))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    left = p.select("*", part("id", n_chunks).alias("chunk"), every(n_blocks, "block")).groupBy("chunk", "block")
    right = q.select("*", part("qid", n_blocks).alias("block"), every(n_chunks, "chunk")).groupBy("chunk", "block")
    known = set(schema)

    def meet(examples: pa.Table, asked: pa.Table) -> pa.Table:
        index = Chunk(examples, known) if examples.num_rows and asked.num_rows else None
        out: dict[str, list] = {f.split()[0]: [] for f in _FIELDS.split(", ")}
        for row in asked.to_pylist() if index else ():
            found = index.best(row["qid"], row["text"], row["form"], row["types"], row["words"], row["constrained"], n)
            out["qid"].append(np.full(len(found["id"]), row["qid"]))
            for c, v in found.items():
                out[c].append(v)
        kinds = {"single": np.int32, "focused": np.int32, "score": np.float64, "similarity": np.float64}
        arrays = {c: np.concatenate([np.zeros(0, kinds.get(c, np.int64)), *v]).astype(kinds.get(c, np.int64)) for c, v in out.items() if c != "event_types"}
        lists = pa.array([t for v in out["event_types"] for t in v], pa.list_(pa.string()))
        return pa.table([*(pa.array(arrays[c]) for c in arrays), lists], names=[*arrays, "event_types"])

    partial = left.cogroup(right).applyInArrow(meet, _FIELDS)
    order = [F.desc(c) if not c.startswith("-") else F.asc(c[1:]) for c in _ORDER]
    kind = F.array_sort(F.array_distinct("event_types"))
    places = partial.withColumn("kind", kind).withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(*order))).withColumn("first", F.row_number().over(W.partitionBy("qid", "kind").orderBy("place")))
    return places.where((F.col("place") <= n) | (F.col("first") == 1)).drop("kind", "first", "single", "focused")


def selected(queries: DataFrame, pool: DataFrame, mode: str, n: int = 3, schema: list[str] = ()) -> DataFrame:
    """(qid, ids) of ``n`` examples for each query: the first of the pool by id (static), or ranked by the text (dynamic, contrastive).

    At least one is asked for, at most as many as there are. A query without
    a text, or to which no other example is left, gets the static ones.
    """
    if mode not in ("static", "dynamic", "contrastive"):
        raise ValueError(f"unknown selection mode {mode}")
    n = max(1, n)
    # the first ids of a pool are n numbers
    fixed = pool.select("id").orderBy("id").limit(n).agg(F.coalesce(F.array_sort(F.collect_list("id")), F.array().cast("array<bigint>")))
    asked = queries.select("qid", (F.coalesce(F.trim("text"), F.lit("")) != "").alias("_some")).withColumn("_fixed", fixed.scalar())
    if mode == "static":
        return asked.select("qid", F.col("_fixed").alias("ids"))
    found = covering(ranked(queries, pool, n, schema), n)
    return asked.join(found, "qid", "left").select("qid", F.when(F.col("_some"), F.coalesce("ids", "_fixed")).otherwise(F.col("_fixed")).alias("ids"))


def covering(top: DataFrame, n: int = 3) -> DataFrame:
    """(qid, ids) of ``ranked`` rows: by place, first those that add a type, then the rest, up to ``n``."""
    ranked = F.array_sort(F.collect_list(F.struct("place", "id", "event_types")))
    zero = F.struct(F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<string>").alias("seen"))

    def step(s: Column, x: Column) -> Column:
        new = (F.size(F.array_except(x["event_types"], s["seen"])) > 0) & (F.size(s["ids"]) < n)
        return F.when(new, F.struct(F.array_append(s["ids"], x["id"]).alias("ids"), F.array_union(s["seen"], x["event_types"]).alias("seen"))).otherwise(s)

    rows = top.groupBy("qid").agg(ranked.alias("r")).withColumn("first", F.aggregate("r", zero, step)["ids"])
    rest = F.filter(F.transform("r", lambda x: x["id"]), lambda i: ~F.array_contains(F.col("first"), i))
    return rows.select("qid", F.slice(F.concat("first", rest), 1, n).alias("ids"))
