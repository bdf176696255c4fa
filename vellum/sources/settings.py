"""Settings files with inheritance, dotted overrides, and choices among paths."""

from __future__ import annotations

import os
from pathlib import Path

import yaml

from vellum.sources.records import merged


def load(path: str, seen: frozenset[Path] = frozenset()) -> dict:
    """A YAML map over the file it ``extends``, if any; a cycle or another root is an error."""
    file = Path(path).resolve()
    if file in seen:
        raise ValueError(f"{file} extends itself")
    value = yaml.safe_load(file.read_text()) or {}
    if not isinstance(value, dict):
        raise TypeError(f"{file} holds no map")
    parent = value.pop("extends", None)
    return merged(load(str(file.parent / parent), seen | {file}), value) if parent else value


def overridden(settings: dict, arguments: list[str]) -> dict:
    """Settings with ``--a.b value`` pairs; values are read as YAML."""
    out = settings
    for name, value in zip(arguments[::2], arguments[1::2]):
        branch: dict | object = yaml.safe_load(value)
        for part in reversed(name.removeprefix("--").split(".")):
            branch = {part: branch}
        out = merged(out, branch)
    return out


def first_existing(candidates: list[str | None]) -> str | None:
    """The first path that exists, else the first of all."""
    paths = list(dict.fromkeys(os.path.normpath(c) for c in candidates if c))
    return next((p for p in paths if os.path.exists(p)), paths[0] if paths else None)


def cache_usable(columns: list[str], needed: list[str], stored: dict, expected: dict) -> bool:
    """A cache serves if it has the columns and everything expected of its metadata."""
    return set(needed) <= set(columns) and all(stored.get(k) == v for k, v in expected.items())


def at(settings: dict, path: str) -> object:
    """The value at a dotted path; none where a part is missing or no map."""
    value: object = settings
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def breaches(settings: dict, required: list[str], choices: dict[str, tuple[str, ...]], removed: dict[str, str], exclusive: list[tuple[str, str]] = ()) -> list[str]:
    """What is wrong with settings: missing paths, values that are none of the choices, removed settings, pairs that exclude each other.

    A choice counts in lower case without blanks; one that is missing is judged by ``required`` alone.
    """
    out = [f"missing setting {p}" for p in required if at(settings, p) is None]
    for path, allowed in choices.items():
        value = str(at(settings, path) or "").strip().lower()
        if value and value not in allowed:
            out.append(f"unsupported {path}: {value}, expected one of {', '.join(allowed)}")
    out += [f"{p} is no longer supported: {why}" for p, why in removed.items() if at(settings, p) is not None]
    return out + [f"{a} and {b} exclude each other" for a, b in exclusive if at(settings, a) and at(settings, b)]


def checked(settings: dict, *rules: object, **more: object) -> dict:
    """The settings, or one error that names all their breaches."""
    if found := breaches(settings, *rules, **more):
        raise ValueError("; ".join(found))
    return settings


def resolved(given: dict, configured: dict, defaults: dict, choices: dict[str, tuple[str, ...]]) -> dict:
    """Each setting of ``defaults``: as given, else as configured, else its default; one outside its choices is an error."""
    out = {k: given.get(k) or configured.get(k) or v for k, v in defaults.items()}
    return checked(out, [], choices, {})


#: Defaults of post-processing.
POSTPROCESS = {
    "enabled": True, "role_whitelist": True, "alias_map": True, "duplicate_role_split": True, "normalization_mode": "diagnostics_only", "grounding_mode": "exact+fuzzy+code_local",
    "sidecar_diagnostics": True, "preserve_ungrounded_arguments": True, "trigger_on_grounding_failure": True,
}


def postprocess_settings(given: dict | None) -> dict:
    """Post-processing settings over their defaults."""
    return POSTPROCESS | (given or {})


def resume_plan(training: dict | None) -> dict:
    """How a training starts: from scratch, warm from a checkpoint, or going on with one, whose state comes back."""
    training = checked(training or {}, [], {}, {"resume_from_checkpoint": "say whether to resume or to start warm"}, exclusive=[("resume_training_from", "warm_start_from_checkpoint")])
    for key, mode in (("resume_training_from", "resume_training"), ("warm_start_from_checkpoint", "warm_start")):
        if path := str(training.get(key) or "").strip():
            return {"mode": mode, "checkpoint_path": path, "restores_training_state": mode == "resume_training"}
    return {"mode": "fresh_start", "checkpoint_path": None, "restores_training_state": False}
