"""Gold against prediction: exact sets, first-fit pairs, record assignment, multisets.

Everything is keyed by document, so one exchange on it serves a whole family of
scores. Groups are those of one document and are never larger than its events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.functions.text import relaxed_match
from vellum.operators.arguments import signatures, slotted


def set_match(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(doc_id, *keys, tp, fp, fn) of distinct keys of both sides: one aggregation instead of a full outer join."""
    held = rows.groupBy("doc_id", *keys).agg(F.max(F.col("side") == "gold").alias("g"), F.max(F.col("side") == "pred").alias("p"))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return held.select("doc_id", *keys, flag(F.col("g") & F.col("p")).alias("tp"), flag(~F.col("g")).alias("fp"), flag(~F.col("p")).alias("fn"))


def row_match(results: DataFrame, keys: Callable[[Column], Column], key: str = "result_id", gold: str = "ground_truth", pred: str = "prediction", carried: tuple[str, ...] = ()) -> DataFrame:
    """``set_match`` of two lists that stand in one row: array set operations, no exchange at all; columns in ``carried`` come along.

    ``keys`` turns an event list into an array of distinct structs, whose fields
    become columns, or of distinct texts, which become the column ``key``.
    Documents must have one row each.
    """
    rows = results.select(F.col(key).alias("doc_id"), *carried, keys(F.col(gold)).alias("g"), keys(F.col(pred)).alias("p"))
    kind = rows.schema["g"].dataType.elementType
    fields = (lambda k: [k[f.name].alias(f.name) for f in kind.fields]) if isinstance(kind, StructType) else (lambda k: [k.alias("key")])

    def marked(array: Column, tp: int, fp: int, fn: int) -> Column:
        return F.transform(array, lambda k: F.struct(*fields(k), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn")))

    every = F.concat(marked(F.array_intersect("g", "p"), 1, 0, 0), marked(F.array_except("p", "g"), 0, 1, 0), marked(F.array_except("g", "p"), 0, 0, 1))
    return rows.select("doc_id", *carried, F.inline(every))


def counted(matched: DataFrame, *by: str) -> DataFrame:
    """Sums of tp, fp and fn."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn")]
    return matched.groupBy(*by).agg(*sums)


def first_fit(bag: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, event_type, role, n_pred, n_gold, tp): predictions in order, each taking the first free gold value it matches."""
    ordered = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("event_idx", "arg_idx", "argument"))))
    lists = bag.groupBy("doc_id", "event_type", "role").agg(ordered("pred").alias("ps"), ordered("gold").alias("gs"))
    lists = lists.select("doc_id", "event_type", "role", F.transform("ps", lambda x: x["argument"]).alias("ps"), F.transform("gs", lambda x: x["argument"]).alias("gs"))

    return lists.select("doc_id", "event_type", "role", F.size("ps").alias("n_pred"), F.size("gs").alias("n_gold"), fitting(F.col("ps"), F.col("gs"), threshold).alias("tp"))


def fitting(preds: Column, golds: Column, threshold: float = 0.5) -> Column:
    """Number of predictions that find a free gold value, each taking the first that matches."""

    def take(state: Column, p: Column) -> Column:
        free = F.transform(golds, lambda g, i: ~F.array_contains(state, i + 1) & relaxed_match(p, g, threshold))
        at = F.array_position(free, True).cast("int")
        return F.when(at > 0, F.array_append(state, at)).otherwise(state)

    return F.size(F.aggregate(preds, F.array().cast("array<int>"), take))


def row_fitting(preds: Column, golds: Column, threshold: float = 0.5) -> Column:
    """``first_fit`` of two ``relaxed_list`` columns that stand in one row, summed over their keys."""
    shared = F.array_intersect(F.transform(preds, lambda x: x["key"]), F.transform(golds, lambda x: x["key"]))
    of = lambda c, k: F.transform(F.filter(c, lambda x: x["key"] == k), lambda x: x["value"])
    return F.aggregate(shared, F.lit(0), lambda s, k: s + fitting(of(preds, k), of(golds, k), threshold))


def assign(preds: list[dict[str, str]], golds: list[dict[str, str]], roles: list[str]) -> dict[str, list[int]]:
    """[tp, fp, fn] per role of greedy one-to-one assignment.

    Predictions go by number of filled slots, most first; each takes the first
    remaining gold record with most equal slots, empty ones included.
    """
    counts = {r: [0, 0, 0] for r in roles}
    left = list(golds)
    for p in sorted(preds, key=lambda x: -len(x)):
        if not left:
            for r in p:
                counts[r][1] += 1
            continue
        best = max(range(len(left)), key=lambda i: (sum(p.get(r) == left[i].get(r) for r in roles), -i))
        g = left.pop(best)
        for r in roles:
            a, b = p.get(r), g.get(r)
            if a is None and b is None:
                continue
            if a == b:
                counts[r][0] += 1
            else:
                counts[r][1] += a is not None
                counts[r][2] += b is not None
    for g in left:
        for r in g:
            counts[r][2] += 1
    return counts


def _by_type(records: list[dict]) -> dict[str, list[dict[str, str]]]:
    out: dict[str, list[dict[str, str]]] = {}
    for r in records or []:
        out.setdefault(r["event_type"], []).append({s["role"]: s["value"] for s in r["slots"]})
    return out


def role_sums(preds: Column, golds: Column) -> Column:
    """(tp, fp, fn) of ``assign`` over all types of two ``slotted`` columns that stand in one row."""

    @F.arrow_udf("struct<tp:bigint,fp:bigint,fn:bigint>")
    def run(ps: pa.Array, gs: pa.Array) -> pa.Array:
        sums: list[list[int]] = []
        for p, g in zip(ps.to_pylist(), gs.to_pylist()):
            p_kinds, g_kinds = _by_type(p), _by_type(g)
            parts = [(p_kinds.get(k, []), g_kinds.get(k, [])) for k in p_kinds.keys() | g_kinds.keys()]
            counts = [n for a, b in parts for n in assign(a, b, sorted({r for rec in a + b for r in rec})).values()]
            sums.append([sum(c[i] for c in counts) for i in range(3)])
        return pa.StructArray.from_arrays([pa.array([s[i] for s in sums], pa.int64()) for i in range(3)], names=["tp", "fp", "fn"])

    return run(preds, golds)


def assigned(results: DataFrame, key: str = "result_id", gold: str = "ground_truth", pred: str = "prediction") -> DataFrame:
    """(doc_id, event_type, role, tp, fp, fn) of ``assign`` over the records of each document and type.

    Both lists stand in one row, so rows stream through Python in batches and
    nothing is exchanged. Documents must have one row each.
    """
    rows = results.select(F.col(key).alias("doc_id"), slotted(F.col(pred)).alias("ps"), slotted(F.col(gold)).alias("gs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "event_type", "role", "tp", "fp", "fn"]
        for batch in batches:
            out: list[tuple] = []
            for doc, ps, gs in zip(*(c.to_pylist() for c in batch.columns)):
                preds, golds = _by_type(ps), _by_type(gs)
                for kind in sorted(preds.keys() | golds.keys()):
                    p, g = preds.get(kind, []), golds.get(kind, [])
                    roles = sorted({r for rec in p + g for r in rec})
                    out += [(doc, kind, r, *n) for r, n in assign(p, g, roles).items()]
            columns_out = list(zip(*out)) if out else [()] * 6
            types = [batch.column(0).type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns_out, types)], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, event_type string, role string, tp int, fp int, fn int")


def shared_times(p: Column, g: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    times = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    return F.aggregate(F.array_intersect(p, g), F.lit(0), lambda s, x: s + F.least(times(p, x), times(g, x)))


def multiset_overlap(results: DataFrame, with_type: bool = True, key: str = "result_id", gold: str = "ground_truth", pred: str = "prediction") -> DataFrame:
    """(doc_id, tp, fp, fn) of whole-record signatures, each counted as often as it occurs; rows without records are left out."""
    rows = results.select(F.col(key).alias("doc_id"), signatures(slotted(F.col(pred)), with_type).alias("p"), signatures(slotted(F.col(gold)), with_type).alias("g"))
    counted_rows = rows.where("size(p) + size(g) > 0").select("doc_id", shared_times(F.col("p"), F.col("g")).cast("bigint").alias("tp"), F.size("p").cast("bigint").alias("np"), F.size("g").cast("bigint").alias("ng"))
    return counted_rows.select("doc_id", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"))


def dice(a: Column, b: Column) -> Column:
    """Dice overlap of two arrays of distinct values: 1 if both are empty, 0 if one is."""
    both = (F.size(a) + F.size(b)).cast("double")
    return F.when(both == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / both)
