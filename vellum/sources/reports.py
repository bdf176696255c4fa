"""Sinks and sources of run artifacts: documents, sidecars, manifests, caches, graphs, tables as text.

Tables are written by the executors. Only documents and texts of a stated size
are written by the driver: a table of more than ``most`` rows is refused.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import strip, truncated
from vellum.sources.records import EVENT, json_lines
from vellum.sources.settings import cache_usable

#: Most rows of a table that is made into text.
MOST = 10_000


def write_document(value: dict, path: str) -> str:
    """One JSON document, folders made as needed."""
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return str(file)


def read_document(path: str) -> dict:
    """One JSON document that is a map."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise TypeError(f"{path} holds no map")
    return value


def write_sidecar(results: DataFrame, path: str, key: str = "result_id", diagnostics: str = "parse_diagnostics") -> None:
    """Diagnostics of every row that has some, as JSON lines beside the results."""
    results.where(F.col(diagnostics).isNotNull()).select(key, diagnostics).write.mode("overwrite").json(path)


def write_split(split: DataFrame, path: str, seed: int, ratio: float) -> None:
    """A split (row_id, part) partitioned by part, with seed and ratio on every row."""
    split.withColumn("seed", F.lit(seed)).withColumn("tune_ratio", F.lit(ratio)).write.mode("overwrite").partitionBy("part").parquet(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A written split; a key in both parts is an error naming it."""
    split = spark.read.parquet(path)
    both = split.groupBy("row_id").agg(F.count_distinct("part").alias("n")).where("n > 1").select("row_id").limit(1).collect()
    if both:
        raise ValueError(f"row {both[0][0]} is in both parts of {path}")
    return split


def write_cache(rows: DataFrame, path: str, metadata: dict) -> None:
    """Training rows with the settings they were made with."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(json.dumps(metadata, sort_keys=True, ensure_ascii=False),)], "metadata string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_cache(spark: SparkSession, path: str, needed: list[str], expected: dict) -> DataFrame | None:
    """Cached training rows, or none if there are none, a column is missing or a setting differs."""
    from pyspark.errors import AnalysisException

    try:
        rows, stored = spark.read.parquet(f"{path}/rows"), spark.read.schema("metadata string").json(f"{path}/metadata").first()
    except AnalysisException:
        return None
    return rows if stored and cache_usable(rows.columns, needed, json.loads(stored[0]), expected) else None


def write_graph(tree: DataFrame, path: str) -> None:
    """A (child, parent) graph as GML lines, nodes before edges, numbered by name."""
    nodes = tree.select(F.col("child").alias("n")).unionByName(tree.select(F.col("parent").alias("n"))).distinct()
    quoted = lambda c: F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), '"', "&quot;")
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(2**53))
    head = tree.sparkSession.createDataFrame([(0, "graph [\n  directed 1"), (3, "]")], "place int, value string")
    node = nodes.select(F.lit(1).alias("place"), F.format_string('  node [\n    id %d\n    label "%s"\n  ]', number(F.col("n")), quoted(F.col("n"))).alias("value"))
    edge = tree.select(F.lit(2).alias("place"), F.format_string("  edge [\n    source %d\n    target %d\n  ]", number(F.col("parent")), number(F.col("child"))).alias("value"))
    head.unionByName(node).unionByName(edge).repartitionByRange(1, "place").sortWithinPartitions("place", "value").select("value").write.mode("overwrite").text(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(child, parent) of GML files; without a readable edge the table is empty, so a caller can rebuild it."""
    whole = spark.read.text(path, wholetext=True)
    found = lambda pattern, group: F.regexp_extract_all("value", F.lit(pattern), F.lit(group))
    node = r'node \[\s*id (\d+)\s*label "([^"]*)"'
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "&quot;", '"'), "&amp;", "&")
    nodes = whole.select(F.inline(F.arrays_zip(found(node, 1).alias("id"), found(node, 2).alias("label")))).select("id", plain(F.col("label")).alias("label"))
    edge = r"edge \[\s*source (\d+)\s*target (\d+)"
    edges = whole.select(F.inline(F.arrays_zip(found(edge, 1).alias("s"), found(edge, 2).alias("t"))))
    return edges.join(nodes.toDF("s", "parent"), "s").join(nodes.toDF("t", "child"), "t").select("child", "parent")


def read_silver(spark: SparkSession, path: str, limit: int = 3500, most: int | None = None, prefix: str = "teacher") -> DataFrame:
    """(id, text, events, event_types) of consensus rows; ids get a prefix. The first ``most`` lines are taken before empty ones are left out."""
    lines = json_lines(spark, path)
    lines = lines.limit(most) if most and most > 0 else lines
    rows = lines.select(F.from_json("value", f"struct<id:string,text:string,event_list:array<{EVENT}>>").alias("r")).select("r.*")
    events = F.filter("event_list", lambda e: e.isNotNull())
    clean = rows.select(strip(F.coalesce("id", F.lit(""))).alias("id"), strip(F.coalesce("text", F.lit(""))).alias("text"), events.alias("events"))
    clean = clean.where("id <> '' and text <> '' and size(events) > 0")
    types = F.array_distinct(F.filter(F.transform("events", lambda e: strip(F.coalesce(e["event_type"], F.lit("")))), lambda t: t != ""))
    return clean.select(F.concat(F.lit(f"{prefix}::"), "id").alias("id"), truncated(F.col("text"), limit, "...").alias("text"), "events", types.alias("event_types"))


def _cells(rows: DataFrame, order: tuple[str, ...], decimals: int, scale: float) -> tuple[list[str], list[list[str]]]:
    found = rows.orderBy(*order).limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"a table of more than {MOST} rows is no report; write it as Parquet")
    cell = lambda v: "" if v is None else f"{v * scale:.{decimals}f}" if isinstance(v, float) else str(v)
    return rows.columns, [[cell(v) for v in r] for r in found]


def markdown(rows: DataFrame, *order: str, decimals: int = 4) -> str:
    """A small table as Markdown text."""
    head, body = _cells(rows, order, decimals, 1.0)
    return "\n".join(f"| {' | '.join(x)} |" for x in [head, ["---"] * len(head), *body])


def latex(rows: DataFrame, *order: str, caption: str = "", decimals: int = 2) -> str:
    """A small table as LaTeX text; doubles as percentages."""
    head, body = _cells(rows, order, decimals, 100.0)
    safe = lambda s: re.sub(r"([&%$#_{}])", r"\\\1", s)
    lines = [" & ".join(map(safe, r)) + r" \\" for r in (head, *body)]
    return "\n".join([r"\begin{table}", rf"\caption{{{safe(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(head)}}}", r"\hline", lines[0], r"\hline", *lines[1:], r"\hline", r"\end{tabular}", r"\end{table}"])


def report_text(metrics: DataFrame, title: str, decimals: int = 4) -> str:
    """(metric, value) rows as lines of text under a title, sorted by name."""
    _, body = _cells(metrics.select("metric", "value"), ("metric",), decimals, 1.0)
    width = max((len(m) for m, _ in body), default=0)
    return "\n".join([title, "=" * max(len(title), 1), *(f"{m:<{width}}  {v}" for m, v in body)])


def export_negatives(rows: DataFrame, path: str, previews: dict[str, int]) -> None:
    """Generated negatives, those the verifier filtered, and a summary by strategy; long fields as previews."""
    short = [F.substring(c, 1, previews[c]).alias(c) if c in previews else F.col(c) for c in rows.columns]
    rows.where("not filtered").select(*short).write.mode("overwrite").json(os.path.join(path, "generated"))
    rows.where("filtered").select(*short).write.mode("overwrite").json(os.path.join(path, "filtered"))
    rows.groupBy("strategy").agg(F.count("*").alias("n"), F.count_if("filtered").alias("n_filtered")).write.mode("overwrite").json(os.path.join(path, "summary"))


def write_history(states: DataFrame, path: str, settings: dict) -> None:
    """The history of an ordered fold and its final state per key as JSON lines, and the settings beside them."""
    states.write.mode("overwrite").json(os.path.join(path, "history"))
    states.groupBy("key").agg(F.max("step").alias("steps"), F.max_by("competence", "step").alias("competence")).write.mode("overwrite").json(os.path.join(path, "final"))
    states.sparkSession.createDataFrame([(json.dumps(settings, sort_keys=True),)], "settings string").coalesce(1).write.mode("overwrite").json(os.path.join(path, "settings"))


def slug(name: str) -> str:
    """A name as part of a path: lower case, other signs as single underscores; never empty."""
    return re.sub(r"[^a-z0-9._-]+", "_", name.strip().lower()).strip("_.") or "default"


def run_manifest(task: str, meta: dict, artifacts: dict[str, str], contract: dict | None = None, errors: list[dict] = ()) -> dict:
    """Provenance of a run; of errors of one code and stage the first is kept."""
    kept: dict[tuple, dict] = {}
    for e in errors:
        kept.setdefault((e.get("code"), e.get("stage")), e)
    return {"task": task, "meta": dict(meta), "artifacts": {k: v for k, v in artifacts.items() if v}, "contract": contract or {}, "validation_errors": list(kept.values()), "status": "invalid" if kept else "ok"}
