"""Rows through a caller's function: retries inside the task, failures as rows."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from partloom.config import RetryConfig

Infer = Callable[..., dict]
# Transport, malformed answers, missing keys: what a second call may mend.
RETRYABLE = (OSError, ValueError, KeyError)


def pluggable_scorer(
    df: DataFrame,
    infer: Infer,
    result: StructType,
    retry: RetryConfig = RetryConfig(),
    retryable: tuple[type[Exception], ...] = RETRYABLE,
) -> DataFrame:
    """Calls `infer` for each row (a dict in, a dict of `result` fields out).

    A call that fails with a `retryable` error is tried again after a wait that grows with each try; what
    still fails, or fails otherwise, becomes a row with its error, so one bad row never stops a run. If
    `infer` takes an argument `attempt` it gets the number of the try, from 1. Rows travel as Arrow batches, so
    whole numbers stay whole next to nulls. Put cheap filters before this: Spark does not move
    them across a Python function.
    """
    status = [StructField("attempts", IntegerType()), StructField("status", StringType()), StructField("error", StringType())]
    schema = StructType([*df.schema.fields, *result.fields, *status])
    names = [f.name for f in result.fields]
    # Plain numbers, so that workers need nothing but this function.
    most, wait = retry.max_attempts, retry.backoff_seconds
    numbered = "attempt" in inspect.signature(infer).parameters
    arrow = to_arrow_schema(schema)

    def call(row: dict) -> dict:
        error = ""
        for attempt in range(1, most + 1):
            try:
                answer = infer(row, attempt=attempt) if numbered else infer(row)
                return {**{n: answer.get(n) for n in names}, "attempts": attempt, "status": "completed", "error": None}
            except Exception as exc:  # noqa: BLE001
                error = str(exc)
                if not isinstance(exc, retryable):
                    break
                if attempt < most:
                    time.sleep(wait * attempt)
        return {**{n: None for n in names}, "attempts": attempt, "status": "failed", "error": error}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist([{**row, **call(dict(row))} for row in rows], schema=arrow)

    return df.mapInArrow(run, schema)
