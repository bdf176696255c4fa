"""Readers and writers of samples, schemas, aliases, results and manifests as JSON lines, JSON or YAML."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.jsonops import value as one_value
from vellum.functions.text import strip, truncated

EVENT = "struct<event_type:string,trigger:string,arguments:array<struct<role:string,argument:string>>>"
SAMPLE = f"struct<id:string,title:string,text:string,event_list:array<{EVENT}>>"


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the non-blank lines of JSON-lines files."""
    return spark.read.text(path).where(F.length(strip(F.col("value"))) > 0)


def read_samples(spark: SparkSession, path: str, limit: int = 3500, strict: bool = True) -> DataFrame:
    """(id, text, events, event_types) of annotated samples; a broken line or empty text is an error, or with ``strict`` off is left out."""
    rows = json_lines(spark, path).select("value", F.from_json("value", SAMPLE, {"mode": "PERMISSIVE"}).alias("r"))
    bad = one_value(F.col("value")).isNull() | (strip(F.coalesce("r.text", F.lit(""))) == "")
    if strict:
        rows = rows.where(F.when(bad, F.raise_error(F.concat(F.lit("bad sample: "), F.substring("value", 1, 80))).cast("boolean")).otherwise(F.lit(True)))
    else:
        rows = rows.where(~bad)
    return shaped(rows.select(F.col("r.id").alias("id"), F.col("r.text").alias("text"), F.col("r.event_list").alias("events")), limit)


def shaped(rows: DataFrame, limit: int = 3500) -> DataFrame:
    """Samples with long texts cut and marked, and the distinct types of their events."""
    types = F.array_distinct(F.filter(F.transform(F.filter("events", lambda e: e.isNotNull()), lambda e: e["event_type"]), lambda t: F.coalesce(t, F.lit("")) != ""))
    return rows.withColumn("text", truncated(F.col("text"), limit, "...")).withColumn("event_types", F.coalesce(types, F.array().cast("array<string>")))


def read_schema(spark: SparkSession, path: str) -> DataFrame:
    """(event_type, role, role_pos) of schema lines; of a type given twice the last line counts."""
    rows = json_lines(spark, path).select(F.from_json("value", "struct<event_type:string,role_list:array<struct<role:string>>>").alias("r"), F.monotonically_increasing_id().alias("n"))
    last = rows.groupBy("r.event_type").agg(F.max_by("r.role_list", "n").alias("roles"))
    return last.select("event_type", F.posexplode("roles").alias("role_pos", "x")).select("event_type", "x.role", "role_pos")


def text_index(samples: DataFrame, key: str = "id", order: str = "row_id") -> DataFrame:
    """(key, text): the last non-blank text of each non-blank key."""
    rows = samples.select(strip(F.col(key)).alias(key), strip(F.col("text")).alias("text"), order).where(f"{key} <> '' and text <> ''")
    return rows.groupBy(key).agg(F.max_by("text", order).alias("text"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(event_type, alias, canonical) of a YAML or JSON file; empty if it is missing or holds none."""
    file, book = Path(path), {}
    if file.is_file():
        if file.suffix in (".yaml", ".yml"):
            import yaml

            book = yaml.safe_load(file.read_text()) or {}
        else:
            book = json.loads(file.read_text())
    book = book.get("event_role_aliases", book) if isinstance(book, dict) else {}
    rows = [(k, str(a).strip(), str(c).strip()) for k, m in book.items() if isinstance(m, dict) for a, c in m.items() if str(a).strip() and str(c).strip()]
    return spark.createDataFrame(rows, "event_type string, alias string, canonical string")


def merged(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``, nested maps merged."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_protocol(path: str, defaults: dict) -> dict:
    """Settings of a YAML or JSON file over defaults; a missing file gives the defaults."""
    file = Path(path)
    if not file.is_file():
        return defaults
    import yaml

    value = yaml.safe_load(file.read_text())
    if not isinstance(value, dict):
        raise TypeError(f"{path} holds no map")
    return merged(defaults, value)


def write_results(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines, in total order if columns are named."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def write_edges(tree: DataFrame, path: str) -> None:
    """A graph as a Parquet table of its edges."""
    tree.write.mode("overwrite").parquet(path)


def markdown(rows: DataFrame, *order: str) -> str:
    """A small table as Markdown text; doubles with four decimals."""
    head = rows.columns
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [" | ".join(cell(v) for v in r) for r in rows.orderBy(*order).collect()]
    return "\n".join(f"| {x} |" for x in [" | ".join(head), " | ".join("---" for _ in head), *lines])
