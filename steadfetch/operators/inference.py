"""Models as batch functions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BatchFn = Callable[[pd.DataFrame], pd.Series]

# Faults of the program, not of a call: they end the job.
PROGRAM_ERRORS = (TypeError, NameError, AttributeError, LookupError, ImportError, SyntaxError, AssertionError, NotImplementedError)
# A task stops asking after this many batches in a row of which no row was answered.
BREAK_AFTER = 3
NOT_ASKED = "not asked: the model had failed for whole batches"


def call_batches(
    df: DataFrame, fn: BatchFn, name: str, dtype: T.DataType | None = None, concurrency: int | None = None,
    inputs: list[str] | None = None, attempts: int = 3, pause: float = 1.0, break_after: int = BREAK_AFTER,
) -> DataFrame:
    """Adds column `name`, a struct (answer, error, attempts) from fn(batch), one call per Arrow batch.

    Only the `inputs` (all columns if not given) go to Python and only the struct comes back, so
    no other value can change on the way. A call that raises is repeated `attempts` times with
    growing pauses; then the batch is halved again and again, without pauses, until the rows that make it fail
    are alone: they have an error and no answer. A task whose model fails for `break_after` whole batches in a
    row asks no more, and its remaining rows say so, so a model that is down costs a bounded wait. Faults of
    the program (a wrong name, key or type) are raised. `concurrency` sets how many tasks call the model at a
    time. No filter passes through this step. Write the result before it is used twice.
    """
    kind = dtype or T.StringType()
    shape = T.StructType([T.StructField("answer", kind), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for batch in batches:
            if failed >= break_after:
                rows = [(None, NOT_ASKED, 0)] * len(batch)
            else:
                rows = _answers(fn, batch, attempts, pause, 0)
                failed = failed + 1 if rows and all(r[1] is not None for r in rows) else 0
            yield pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(("answer", "error", "attempts"))})

    udf = F.pandas_udf(ask, shape, F.PandasUDFType.SCALAR_ITER).asNondeterministic()
    source = df.repartition(concurrency) if concurrency else df
    return source.withColumn(name, udf(F.struct(*[F.col(c) for c in inputs or df.columns])))


def _answers(fn: BatchFn, batch: pd.DataFrame, attempts: int, pause: float, before: int) -> list[tuple]:
    """(answer, error, attempts) of each row; only the whole batch is waited for."""
    error = ""
    for n in range(max(attempts, 1)):
        try:
            answers = list(fn(batch))
            if len(answers) != len(batch):
                raise TypeError(f"the model gave {len(answers)} answers to {len(batch)} rows")
            return [(a, None, before + n + 1) for a in answers]
        except PROGRAM_ERRORS:
            raise
        except Exception as fault:  # whatever a model's client raises
            error = f"{type(fault).__name__}: {fault}"
            if n + 1 < attempts and pause:
                time.sleep(pause * 2**n)
    asked = before + max(attempts, 1)
    if len(batch) <= 1:
        return [(None, error, asked)] * len(batch)
    half = len(batch) // 2
    return _answers(fn, batch.iloc[:half], 1, 0.0, asked) + _answers(fn, batch.iloc[half:], 1, 0.0, asked)


def failed(called: DataFrame, name: str) -> DataFrame:
    """The rows without an answer because of an error, in the form they were asked in: the table to resume from."""
    return called.where(F.col(f"{name}.error").isNotNull()).drop(name)


def resume(called: DataFrame, fn: BatchFn, name: str, **how) -> DataFrame:
    """Asks again for the rows that failed; all others keep their answers. `called` should be a written table."""
    kept = called.where(F.col(f"{name}.error").isNull())
    again = call_batches(failed(called, name), fn, name, called.schema[name].dataType["answer"].dataType, **how)
    return kept.unionByName(again)


def apply_batches(
    df: DataFrame, fn: BatchFn, name: str, dtype: T.DataType | None = None, concurrency: int | None = None,
    inputs: list[str] | None = None, attempts: int = 3, pause: float = 1.0,
) -> DataFrame:
    """Adds column `name` = the answers of `call_batches`; a row whose call fails has null, which callers can count."""
    called = call_batches(df, fn, "_call", dtype, concurrency, inputs, attempts, pause)
    return called.withColumn(name, F.col("_call.answer")).drop("_call")
