"""Batch inference with an injected scorer.

The scorer stands for the model call.  It gets the ``modelInput`` of one record
and returns the ``modelOutput``; whatever it raises becomes an error line of that
record and never fails the task.  ``make_scorer`` runs once per partition, so a
client is opened per task, not per record.  Tasks may be repeated, so a scorer
with side effects should use the record id as its idempotency key.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.preview import request_preview
from .results import parse_results

Scorer = Callable[[str, dict], dict]


class ScoringError(Exception):
    """An error a scorer reports with a code and a retry hint."""

    def __init__(self, message: str, code: int | str = 500, retryable: bool = False):
        super().__init__(message)
        self.code = code
        self.retryable = retryable


def _answer(score: Scorer, record_id: str, line: str) -> str:
    """The result line; whatever the scorer raises or returns becomes one."""
    try:
        output = score(record_id, json.loads(line)["modelInput"])
        return json.dumps({"recordId": record_id, "modelOutput": output}, ensure_ascii=False)
    except Exception as problem:
        code = getattr(problem, "code", 500)
        error = {
            "errorCode": code if isinstance(code, (int, str)) else str(code),
            "errorMessage": str(problem),
            "retryable": bool(getattr(problem, "retryable", False)),
        }
        return json.dumps({"recordId": record_id, "error": error}, ensure_ascii=False)


def infer_batch(
    requests: DataFrame,
    make_scorer: Callable[[], Scorer],
    keep: tuple[str, ...] = (),
    tasks: int | None = None,
) -> DataFrame:
    """One result line per request (``record_id, value``) and its seconds.

    ``requests`` has ``record_id`` and the request line in ``value``; ``keep``
    names string columns to carry along.  Rows stay in their partitions unless
    ``tasks`` asks for more of them, which pays when scoring is slower than
    moving the requests.  Arrow batches are bounded in bytes by the session
    setting ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make_scorer()
        for batch in batches:
            lines, seconds = [], []
            for rid, line in zip(batch["record_id"], batch["value"]):
                began = time.monotonic()
                lines.append(_answer(score, rid, line))
                seconds.append(time.monotonic() - began)
            yield batch.assign(value=lines, seconds=seconds)

    carried = "".join(f", {c} string" for c in keep)
    schema = f"record_id string, value string{carried}, seconds double"
    rows = requests.select("record_id", "value", *keep)
    if tasks:
        rows = rows.repartition(tasks, "record_id")
    return rows.mapInPandas(run, schema)


def infer_sample(requests: DataFrame, make_scorer: Callable[[], Scorer], info: str = "record_id") -> DataFrame:
    """Dry run of a few sampled requests: text, stop reason, tokens, seconds, request preview.

    ``requests`` should already be a small sample (``sample_objects`` or
    ``first_request``); ``info`` names the column that says where a row is from.
    Each request is scored once.
    """
    sample = requests.select(
        "record_id",
        "value",
        F.col(info).cast("string").alias("file_info"),
        request_preview("value").alias("model_input_preview"),
    )
    scored = infer_batch(sample, make_scorer, keep=("file_info", "model_input_preview"))
    scored = scored.withColumnsRenamed({"record_id": "sample_id", "value": "line"})
    rows = parse_results(scored, tokens=True)
    ok = ~F.col("has_error")
    return rows.select(
        "file_info",
        ok.alias("success"),
        F.when(ok, F.col("output_text")).alias("output_text"),
        F.when(ok, F.col("stop_reason")).alias("stop_reason"),
        F.when(ok, F.col("input_tokens")).alias("input_tokens"),
        F.when(ok, F.col("output_tokens")).alias("output_tokens"),
        "seconds",
        "model_input_preview",
        F.when(~ok, F.col("error_message")).alias("error"),
    )
