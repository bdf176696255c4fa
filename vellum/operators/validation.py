"""Experiment contracts and checks of report documents; every check gives one row per breach and none for sound input.

Documents are JSON texts, one per row, and are read as variants, so a check
reads any layout and no schema is inferred. Null, broken and non-object
documents lack everything. Repeated documents give their breaches each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.contracts import differing

#: Fields of an experiment contract.
CONTRACT_FIELDS = (
    "model_family", "model_kind", "split", "primary_metric", "stage_mode", "prompt_variant", "fewshot_num_examples", "fewshot_selection_mode", "fewshot_pool_split",
    "train_tune_ratio", "research_split_manifest_path", "research_split_manifest_hash", "pipeline_mode", "postprocess_profile", "canonical_metric_mode",
    "prompt_builder_version", "configured_prompt_builder_version", "parser_version", "configured_parser_version", "normalization_version", "configured_normalization_version",
    "protocol_hash", "role_alias_hash", "seed", "seed_effective", "token_usage_kind",
)
#: Those that its hash covers.
HASHED_FIELDS = (
    "split", "primary_metric", "stage_mode", "prompt_variant", "fewshot_num_examples", "fewshot_selection_mode", "fewshot_pool_split", "train_tune_ratio", "research_split_manifest_hash",
    "pipeline_mode", "postprocess_profile", "canonical_metric_mode", "prompt_builder_version", "parser_version", "normalization_version", "protocol_hash", "role_alias_hash",
)
#: Stage modes and profiles, and old names of the former.
STAGE_MODES, OLD_STAGE_MODES = ("single_pass", "two_stage", "two_stage_per_type"), {"two_stage_typed": "two_stage_per_type"}
PROFILES = ("none", "event_probe_v2")
_NUMBERS = {"fewshot_num_examples": "bigint", "train_tune_ratio": "double", "seed": "bigint", "seed_effective": "bigint"}
_CONFIGURED = ("prompt_builder_version", "parser_version", "normalization_version")


def stage_mode(value: Column) -> Column:
    """A stage mode under its present name; null counts as a single pass, an unknown one gives null."""
    name = F.lower(F.trim(F.when(F.coalesce(value, F.lit("")) == "", "single_pass").otherwise(value)))
    for old, new in OLD_STAGE_MODES.items():
        name = F.when(name == old, new).otherwise(name)
    return F.when(name.isin(*STAGE_MODES), name)


def profile(value: Column) -> Column:
    """A post-processing profile; null counts as none, an unknown one gives null."""
    name = F.lower(F.trim(F.when(F.coalesce(value, F.lit("")) == "", "none").otherwise(value)))
    return F.when(name.isin(*PROFILES), name)


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON of columns in the order of their names."""
    return F.to_json(F.struct(*[columns[n].alias(n) for n in sorted(columns)]), {"ignoreNullFields": "false"})


def contracts(rows: DataFrame, *key: str) -> DataFrame:
    """(key, every contract field, missing, contract_hash) of rows that have some of the fields as columns.

    Modes and profiles come under their present names, configured versions fall
    back to the versions; a field that is absent, null or unknown is ``missing``,
    and a contract that misses any has no hash.
    """
    have = {f: F.col(f).cast(_NUMBERS.get(f, "string")) if f in rows.columns else F.lit(None).cast(_NUMBERS.get(f, "string")) for f in CONTRACT_FIELDS}
    have["stage_mode"], have["postprocess_profile"] = stage_mode(have["stage_mode"]), profile(have["postprocess_profile"])
    for version in _CONFIGURED:
        given = have[f"configured_{version}"]
        have[f"configured_{version}"] = F.coalesce(F.when(given != "", given), have[version], F.lit(""))
    filled = rows.select(*key, *[have[f].alias(f) for f in CONTRACT_FIELDS])
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in sorted(CONTRACT_FIELDS)]))
    digest = F.sha2(canonical_json({f: F.col(f) for f in HASHED_FIELDS}), 256)
    return filled.withColumn("missing", missing).withColumn("contract_hash", F.when(F.size("missing") == 0, digest))


def document_contracts(documents: DataFrame, key: str, payload: str) -> DataFrame:
    """``contracts`` of JSON documents: of their experiment_contract, else of compare with versions from meta."""
    v = F.try_parse_json(payload)
    block = F.coalesce(F.try_variant_get(v, "$.experiment_contract", "variant"), F.try_variant_get(v, "$.compare", "variant"))
    meta = F.when(F.try_variant_get(v, "$.experiment_contract", "variant").isNull(), F.try_variant_get(v, "$.meta", "variant"))
    shared = ("postprocess_profile", *_CONFIGURED, *(f"configured_{c}" for c in _CONFIGURED))
    value = lambda f: F.try_variant_get("block", f"$.{f}", "string")
    rows = documents.select(key, block.alias("block"), meta.alias("meta"))
    return contracts(rows.select(key, *[(F.coalesce(value(f), F.try_variant_get("meta", f"$.{f}", "string")) if f in shared else value(f)).alias(f) for f in CONTRACT_FIELDS]), key)


def disagreeing_fields(found: DataFrame, by: list[str], fields: tuple[str, ...]) -> DataFrame:
    """(by, field, n_values) of contract fields that differ within a group; null counts as a value."""
    long = found.select(*by, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("null")).alias("v")) for f in fields])))
    return long.groupBy(*by, "field").agg(F.count_distinct("v").alias("n_values")).where("n_values > 1")


def absent(value: Column) -> Column:
    """Whether a variant is missing or a JSON null."""
    return value.isNull() | F.is_variant_null(value)


def missing_paths(documents: DataFrame, key: str, payload: str, paths: list[str], label: str = "Missing required field: ") -> DataFrame:
    """(key, error) of dotted paths that a document lacks or that are null."""
    v = F.try_parse_json(payload)
    there = lambda p: ~absent(F.try_variant_get("v", f"$.{p}", "variant"))
    lacking = F.array_compact(F.array(*[F.when(~there(p), F.lit(label + p)) for p in paths]))
    return documents.select(key, v.alias("v")).select(key, F.explode(lacking).alias("error"))


#: Blocks that a report of an evaluation has, its required fields, and the metrics with and without labels.
BLOCKS = ("compare", "experiment_contract", "diagnostics", "cost", "metrics", "analysis")
REQUIRED = (
    "meta.timestamp", "meta.model", "meta.api_response_models", "meta.seed", "meta.command", "meta.config_hash_sha256", "meta.protocol_path", "meta.protocol_hash_sha256",
    "meta.eval_protocol_path", "meta.eval_protocol_hash", "meta.role_alias_path", "meta.role_alias_hash", "meta.prompt_builder_version", "meta.parser_version",
    "meta.normalization_version", "meta.training_mode", "meta.primary_metric", "meta.canonical_metric_mode", "meta.generation.temperature", "meta.generation.max_tokens",
    "meta.prompt_hashes", "token_usage.total_tokens", "token_usage.avg_tokens_per_sample", "api_stats.failed_calls", "runtime.wall_clock_seconds",
    "runtime_manifest.python.version", "runtime_manifest.system.platform",
)
LABELLED = (
    "doc_role_micro_f1", "doc_instance_micro_f1", "doc_combination_micro_f1", "doc_event_type_micro_f1", "single_event_doc_role_micro_f1", "multi_event_doc_role_micro_f1", "strict_f1",
    "relaxed_f1", "type_f1", "parse_error_rate", "parse_success_rate", "primary_metric", "primary_metric_value", "academic_metrics", "bootstrap_ci",
)
UNLABELLED = ("evaluation_mode", "parse_error_rate", "parse_success_rate")


def summary_errors(documents: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, error) of reports of single evaluations: required fields, blocks, contract fields, and metrics by kind of evaluation."""
    kind = F.schema_of_variant(F.try_parse_json(payload))
    v = F.try_parse_json(payload)
    rows = documents.select(key, v.alias("v"), kind.alias("kind"))
    found = lambda p: F.try_variant_get("v", f"$.{p}", "variant")
    null = lambda p: absent(found(p))
    block = lambda b: F.coalesce(F.schema_of_variant(found(b)).startswith("OBJECT"), F.lit(False))
    say = lambda bad, text: F.when(bad, F.lit(text))
    gold = F.coalesce(F.try_variant_get("v", "$.meta.has_gold_labels", "boolean"), F.lit(False))
    has = lambda m: found(f"metrics.{m}").isNotNull()
    checks = [say(null(p), f"Missing required field: {p}") for p in REQUIRED]
    checks += [say(~block(b), f"Missing {b} block") for b in BLOCKS]
    checks += [say(block("compare") & null(f"compare.{f}"), f"Missing required field: compare.{f}") for f in CONTRACT_FIELDS if not f.startswith("configured_")]
    checks += [say(block("experiment_contract") & null(f"experiment_contract.{f}"), f"Missing required field: experiment_contract.{f}") for f in (*CONTRACT_FIELDS, "experiment_contract_hash")]
    checks += [say(block("metrics") & gold & ~has(m), f"Missing metric: {m}") for m in LABELLED]
    checks += [say(block("metrics") & ~gold & ~has(m), f"Missing prediction-only metric: {m}") for m in UNLABELLED]
    checks += [say(block("analysis") & null(f"analysis.{f}"), f"Missing analysis.{f}") for f in ("primary_metric", "protocol")]
    return rows.select(key, F.explode(F.array_compact(F.array(*checks))).alias("error"))


#: Fields of a suite, and those it needs with a single seed.
SUITE = ("timestamp", "config", "dataset", "split", "primary_metric", "aggregated", "significance", "experiment_contracts")
SINGLE_SEED = ("significance_status", "significance_min_pairs", "significance_skipped_reason")


def suite_errors(suites: DataFrame, children: DataFrame, key: str, payload: str, metrics: tuple[str, ...], tolerance: float = 1e-9) -> DataFrame:
    """(key, error) of suites of runs: their fields, seeds, and means against those of the ``children``.

    ``children`` has (key, group, metric, value), the metrics of the single runs.
    The suite's ``aggregated`` holds per group the metrics with their means.
    """
    v = F.try_parse_json(payload)
    rows = suites.select(key, v.alias("v"))
    null = lambda p: absent(F.try_variant_get("v", f"$.{p}", "variant"))
    seeds = F.size(F.coalesce(F.try_variant_get("v", "$.seeds", "array<variant>"), F.array().cast("array<variant>")))
    reported = F.coalesce(F.to_json(F.try_variant_get("v", "$.significance", "variant")), F.lit("{}"))
    checks = [F.when(null(f), F.lit(f"Missing suite field: {f}")) for f in SUITE]
    checks += [F.when(seeds < 1, F.lit("Missing suite field: seeds"))]
    checks += [F.when((seeds == 1) & null(f), F.lit(f"Missing suite field: {f}")) for f in SINGLE_SEED]
    checks += [F.when((seeds == 1) & ~reported.isin("{}", "null"), F.lit("Single-seed suite must not report significance statistics"))]
    shape = rows.select(key, F.explode(F.array_compact(F.array(*checks))).alias("error"))

    book = F.try_variant_get("v", "$.aggregated", "map<string,variant>")
    groups = rows.select(key, F.explode(book).alias("group", "g"))
    named = F.array(*[F.struct(F.lit(m).alias("metric"), F.try_variant_get("g", f"$.metrics.{m}.mean", "double").alias("mean")) for m in metrics])
    means = groups.select(key, "group", F.inline(named))
    recounted = children.where(F.col("metric").isin(*metrics)).groupBy(key, "group", "metric").agg(F.avg("value").alias("expected"))
    known = children.select(key, "group").distinct().withColumn("known", F.lit(True))
    joined = means.join(recounted, [key, "group", "metric"], "left").join(known, [key, "group"], "left")
    name = F.concat_ws(".", "group", "metric")
    off = (
        F.when(F.col("known").isNull(), F.concat(F.lit("Missing child summaries for aggregated group: "), "group"))
        .when(F.col("mean").isNull(), F.concat(F.lit("Missing aggregated mean: "), name))
        .when(F.col("expected").isNull(), F.concat(F.lit("Missing child metric: "), name))
        .when(F.abs(F.col("mean") - F.col("expected")) > tolerance, F.concat(F.lit("Aggregated mean mismatch for "), name, F.format_string(": expected %.6f, got %.6f", "expected", "mean")))
    )
    return shape.unionByName(joined.select(key, off.alias("error")).where("error is not null").distinct())


def recounted(aggregated: DataFrame, children: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Groups (keys, l, r) whose stated mean differs from that of their children, or that stand on one side only."""
    return differing(aggregated, children.groupBy(*keys).agg(F.avg(value).alias(value)), keys, value, tolerance)


def metadata_mismatches(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, l, r) of fields that differ between a summary and its manifest; one that only one side has differs, a null on both does not."""
    long = lambda df, n: df.select(*keys, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(n)) for f in fields])))
    return long(left, "l").join(long(right, "r"), [*keys, "field"]).where(~F.col("l").eqNullSafe(F.col("r")))


def missing_metadata(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, missing): the names, sorted, of required fields that are null or empty."""
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in sorted(fields)]))
    return rows.select(key, F.array_join(lacking, ", ").alias("missing")).where("missing <> ''")


def first_errors(errors: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first error of each code and stage; later ones of the same kind are the same breach."""
    return errors.groupBy(*by).agg(F.min_by(F.struct(*[c for c in errors.columns if c not in by]), order).alias("x")).select(*by, "x.*")
