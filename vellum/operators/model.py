"""Boundary to an external model: a call per prompt, batched by partition, with retries.

The model itself is injected. Equal prompts are called once: keys are deduped
before the call and joined back after it.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of messages of errors that pass.
PASSING = ("timeout", "timed out", "rate limit", "429", "500", "502", "503", "504", "connection", "temporarily", "overloaded", "unavailable")


def passes(message: str) -> bool:
    """Whether an error is worth another try."""
    return any(p in message.lower() for p in PASSING)


def called(prompt: str, call: Callable[[str], str], retries: int, wait: float) -> tuple[str | None, str | None, int]:
    """(response, error, tries) of one prompt; the wait doubles and is spread by the prompt's hash."""
    spread = int(hashlib.sha256(prompt.encode()).hexdigest()[:4], 16) / 65536
    for n in range(retries + 1):
        try:
            return call(prompt), None, n + 1
        except Exception as e:  # the error is data: it goes into the row
            if n == retries or not passes(str(e)):
                return None, str(e), n + 1
            time.sleep(wait * (2**n + 0.8 * spread))
    return None, None, 0


def responses(df: DataFrame, key: str, prompt: str, call: Callable[[str], str], retries: int = 3, wait: float = 1.0) -> DataFrame:
    """(key, response, error, tries) of every row; a null prompt gets nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [called(p, call, retries, wait) for p in b["prompt"]]
            yield pd.DataFrame({"prompt": b["prompt"], "response": [x[0] for x in out], "error": [x[1] for x in out], "tries": [x[2] for x in out]})

    unique = df.where(F.col(prompt).isNotNull()).select(F.col(prompt).alias("prompt")).distinct()
    answered = unique.mapInPandas(run, "prompt string, response string, error string, tries int")
    return df.select(key, F.col(prompt).alias("prompt")).join(answered, "prompt", "left").select(key, "response", "error", "tries")
