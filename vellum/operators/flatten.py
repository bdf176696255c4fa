"""Deeply nested records as flat tables that keep parent-child links.

Lists are flattened on their Arrow buffers: the offsets give every child its
parent index, child arrays are sliced out whole, and keys travel by ``take``.
No value of a row is looked at. JSON payloads are parsed to the same nested
types by the JVM; only payloads that do not have these types anywhere inside
(elements of another kind, a bare event instead of a list) are read one by one.

Results, for every input: a null or empty list gives no row; a null element
counts for ``idx`` and gives no row itself; a null event's arguments give no
row; repeated records give their rows each; an empty table gives no row;
other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARG = pa.struct([("role", pa.string()), ("argument", pa.string())])
EVENT = pa.struct([("event_type", pa.string()), ("trigger", pa.string()), ("arguments", pa.list_(ARG))])
STEPS = pa.list_(pa.string())
_EVENT_DDL = "struct<event_type:string,trigger:string,arguments:array<struct<role:string,argument:string>>>"
#: Kinds of rows, all of which are wanted by default.
NODES = ("ground_truth", "ground_truth.arguments", "prediction", "prediction.arguments", "repair_steps")

NODE_SCHEMA = (
    "src string, record_id bigint, node string, parent_idx int, idx int, "
    "event_type string, trigger string, role string, argument string, step string"
)
_NODE = pa.schema(
    [
        ("src", pa.string()), ("record_id", pa.int64()), ("node", pa.string()), ("parent_idx", pa.int32()),
        ("idx", pa.int32()), ("event_type", pa.string()), ("trigger", pa.string()), ("role", pa.string()),
        ("argument", pa.string()), ("step", pa.string()),
    ]
)


def child_rows(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Children of a list array, with each one's parent row and position in its list."""
    parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    children = pc.list_flatten(lists)
    new = np.r_[True, parents[1:] != parents[:-1]] if len(parents) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    lengths = np.diff(np.r_[starts, len(parents)])
    return children, parents, np.arange(len(parents)) - np.repeat(starts, lengths)


def _emit(src: str, node: str, keys: np.ndarray, parent_idx, idx, **values: pa.Array) -> pa.RecordBatch:
    n = len(keys)
    columns = {
        "src": pa.repeat(pa.scalar(src), n), "record_id": pa.array(keys, pa.int64()), "node": pa.repeat(pa.scalar(node), n),
        "parent_idx": pa.array(parent_idx, pa.int32()), "idx": pa.array(idx, pa.int32()), **values,
    }
    return pa.record_batch([columns.get(f.name, pa.nulls(n, f.type)) for f in _NODE], schema=_NODE)


def _field(values: pa.StructArray, name: str) -> pa.Array:
    return pc.struct_field(values, [name])


def event_rows(src: str, node: str, keys: np.ndarray, lists: pa.Array, nodes: tuple[str, ...] = NODES) -> Iterator[pa.RecordBatch]:
    """Rows of the events in ``lists`` and of their arguments, as far as ``nodes`` has them."""
    events, rows, pos = child_rows(lists)
    there = np.flatnonzero(pc.is_valid(events).to_numpy(zero_copy_only=False))
    events, rows, pos = events.take(pa.array(there)), rows[there], pos[there]
    if node in nodes:
        yield _emit(src, node, keys[rows], np.full(len(rows), -1), pos, event_type=_field(events, "event_type"), trigger=_field(events, "trigger"))
    if f"{node}.arguments" not in nodes:
        return
    args, owner, arg_pos = child_rows(_field(events, "arguments"))
    there = np.flatnonzero(pc.is_valid(args).to_numpy(zero_copy_only=False))
    args, owner, arg_pos = args.take(pa.array(there)), owner[there], arg_pos[there]
    yield _emit(
        src, f"{node}.arguments", keys[rows[owner]], pos[owner], arg_pos,
        event_type=_field(events, "event_type").take(pa.array(owner)), role=_field(args, "role"), argument=_field(args, "argument"),
    )


def step_rows(src: str, keys: np.ndarray, lists: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of the repair steps in ``lists``."""
    steps, rows, pos = child_rows(lists)
    there = np.flatnonzero(pc.is_valid(steps).to_numpy(zero_copy_only=False))
    yield _emit(src, "repair_steps", keys[rows[there]], np.full(len(there), -1), pos[there], step=steps.take(pa.array(there)))


def _plain(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _rows(src: str, nodes: tuple[str, ...], batch: pa.RecordBatch, lists: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    keys = batch.column(0).to_numpy(zero_copy_only=False)
    for node in ("ground_truth", "prediction"):
        if node in lists:
            yield from event_rows(src, node, keys, lists[node], nodes)
    if "repair_steps" in lists:
        yield from step_rows(src, keys, lists["repair_steps"])


def _wanted(nodes: tuple[str, ...]) -> list[str]:
    """The nested columns that ``nodes`` are in."""
    if unknown := set(nodes) - set(NODES):
        raise ValueError(f"unknown nodes {sorted(unknown)}")
    return [c for c in ("ground_truth", "prediction", "repair_steps") if c in nodes or f"{c}.arguments" in nodes]


def flatten_records(df: DataFrame, key: str = "result_id", src: str = "evaluation_results", nodes: tuple[str, ...] = NODES) -> DataFrame:
    """One row per nested item of ``ground_truth``, ``prediction`` and ``parse_diagnostics.repair_steps``; only the columns of ``nodes`` are read."""
    wanted = _wanted(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows(src, nodes, batch, {c: _plain(batch.column(i)) for i, c in enumerate(wanted, 1)})

    columns = [F.col("parse_diagnostics.repair_steps" if c == "repair_steps" else c).alias(f"c_{c}") for c in wanted]
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *columns).mapInArrow(run, NODE_SCHEMA)


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _events(value: object) -> list | None:
    """A payload's events as EVENT values: unwrapped, non-objects as null elements, scalars as their text."""
    if isinstance(value, dict):
        value = value["events"] if isinstance(value.get("events"), list) else [value] if "event_type" in value else None
    if not isinstance(value, list):
        return None
    out = []
    for e in value:
        if not isinstance(e, dict):
            out.append(None)
            continue
        args = e.get("arguments")
        args = [{"role": _text(a.get("role")), "argument": _text(a.get("argument"))} if isinstance(a, dict) else None for a in args] if isinstance(args, list) else None
        out.append({"event_type": _text(e.get("event_type")), "trigger": _text(e.get("trigger")), "arguments": args})
    return out


def _first(payload: dict, *names: str) -> object:
    return next((payload[n] for n in names if payload.get(n) is not None), None)


def _steps(payload: dict) -> list | None:
    diagnostics = payload.get("parse_diagnostics")
    steps = diagnostics.get("repair_steps") if isinstance(diagnostics, dict) else None
    steps = payload.get("repair_steps") if steps is None else steps
    return [_text(s) for s in steps] if isinstance(steps, list) else None


def _merged(parsed: pa.Array, at: np.ndarray, odd: list) -> pa.Array:
    """``parsed`` with the rows ``at`` replaced by ``odd``."""
    if not len(at):
        return parsed
    order = np.arange(len(parsed))
    order[at] = len(parsed) + np.arange(len(at))
    return pa.concat_arrays([parsed, pa.array(odd, parsed.type)]).take(pa.array(order))


def flatten_payloads(df: DataFrame, key: str = "line_id", payload: str = "payload", src: str = "result_lines", nodes: tuple[str, ...] = NODES) -> DataFrame:
    """The same rows of JSON payloads in either layout.

    ``gold`` and ``pred`` count as ``ground_truth`` and ``prediction``; an object
    around the events is taken off; top-level ``repair_steps`` count where the
    diagnostics have none. A null, broken or non-object payload gives no row.
    """
    wanted = _wanted(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _plain(batch.column(1))
            at = np.flatnonzero(pc.is_valid(texts).to_numpy(zero_copy_only=False))
            odd: dict[str, list] = {c: [] for c in ("ground_truth", "prediction", "repair_steps")}
            for text in texts.take(pa.array(at)).to_pylist():
                try:
                    value = json.loads(text)
                except (ValueError, RecursionError):
                    value = None
                value = value if isinstance(value, dict) else {}
                odd["ground_truth"].append(_events(_first(value, "ground_truth", "gold")))
                odd["prediction"].append(_events(_first(value, "prediction", "pred")))
                odd["repair_steps"].append(_steps(value))
            yield from _rows(src, nodes, batch, {c: _merged(_plain(batch.column(i)), at, odd[c]) for i, c in enumerate(wanted, 2)})

    events, steps = f"array<{_EVENT_DDL}>", "repair_steps:array<string>"
    options = {"columnNameOfCorruptRecord": "odd"}
    schema = "struct<ground_truth:{0},gold:{0},prediction:{1},pred:{1},parse_diagnostics:struct<{2}>,{2},odd:string>"
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(payload).alias("p"))
    rows = rows.withColumn("x", F.from_json("p", schema.format(events, events, steps), options))
    # a list of events may sit in an object; read again what did not fit
    odd = F.col("p").isNotNull() & (F.col("x").isNull() | F.col("x.odd").isNotNull())
    rows = rows.withColumn("y", F.when(odd, F.from_json("p", schema.format(events, f"struct<events:{events}>", steps), options)))
    around = F.coalesce("y.prediction", "y.pred")
    unread = odd & (F.col("y").isNull() | F.col("y.odd").isNotNull() | (around.isNotNull() & around["events"].isNull()))
    picked = {
        "ground_truth": F.coalesce("y.ground_truth", "y.gold", "x.ground_truth", "x.gold"),
        "prediction": F.coalesce(around["events"], "x.prediction", "x.pred"),
        "repair_steps": F.coalesce("y.parse_diagnostics.repair_steps", "y.repair_steps", "x.parse_diagnostics.repair_steps", "x.repair_steps"),
    }
    return rows.select("k", F.when(unread, F.col("p")).alias("unread"), *[picked[c].alias(f"c_{c}") for c in wanted]).mapInArrow(run, NODE_SCHEMA)


def nested_items(results: DataFrame, lines: DataFrame, nodes: tuple[str, ...] = NODES) -> DataFrame:
    """Items of both sources in one table."""
    return flatten_records(results, nodes=nodes).unionByName(flatten_payloads(lines, nodes=nodes))
