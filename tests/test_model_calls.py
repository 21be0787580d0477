"""Model calls that fail, and values that must not change on the way."""

import pytest
from pyspark.sql import functions as F

from steadfetch.operators import retrieval
from steadfetch.operators import inference
from steadfetch.operators.inference import apply_batches
from steadfetch.session import settle


def test_ids_stay_and_failing_rows_are_null(spark):
    big = 9007199254740993
    rows = spark.createDataFrame([(big, "a"), (None, "bad"), (big + 2, "c")], "passage_idx bigint, prompt string")

    def model(batch):
        if (batch["prompt"] == "bad").any():
            raise ValueError("no answer")
        return batch["prompt"].str.upper()

    out = apply_batches(rows, model, "answer", inputs=["prompt"], attempts=2, pause=0.0)
    assert sorted(out.collect(), key=str) == sorted([(big, "a", "A"), (None, "bad", None), (big + 2, "c", "C")], key=str)


def asked(spark, n=40):
    return spark.range(n).select(F.col("id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt")).repartition(1)


def test_failures_are_rows_and_can_be_resumed(spark):
    def picky(batch):
        if (batch["id"] % 10 == 3).any():
            raise ConnectionError("refused")
        return batch["prompt"].str.upper()

    called = settle(inference.call_batches(asked(spark), picky, "call", inputs=["id", "prompt"], attempts=2, pause=0.0))
    rows = {r["id"]: r["call"] for r in called.collect()}
    assert {k for k, c in rows.items() if c["error"]} == {3, 13, 23, 33}
    assert all(c["answer"] == f"P{k}" for k, c in rows.items() if not c["error"]) and rows[3]["error"] == "ConnectionError: refused"
    assert inference.failed(called, "call").columns == ["id", "prompt"]
    again = inference.resume(called, lambda b: b["prompt"], "call", inputs=["prompt"], pause=0.0)
    got = {r["id"]: r["call"]["answer"] for r in again.collect()}
    assert len(got) == 40 and got[3] == "p3" and got[4] == "P4"


def test_a_model_that_is_down_is_left_alone(spark):
    def down(batch):
        raise TimeoutError("no reply")

    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = inference.call_batches(asked(spark), down, "call", inputs=["prompt"], attempts=1, pause=0.0, break_after=3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    assert sum(r["call"]["error"] == inference.NOT_ASKED for r in rows) == 28
    assert all(r["call"]["answer"] is None for r in rows)


def test_faults_of_the_program_show(spark):
    with pytest.raises(Exception, match="no_such_column"):
        apply_batches(asked(spark), lambda b: b["no_such_column"], "x", pause=0.0).collect()


def test_nested_hits_have_no_limit_and_keep_all_queries(spark):
    hits = spark.range(150).select(
        F.lit(1).alias("query_idx"), F.lit(0).alias("pert_idx"), F.col("id").alias("rank"),
        F.col("id").alias("passage_idx"), F.lit("t").alias("text"), F.lit(0.5).alias("score"),
    )
    asked = spark.createDataFrame([(1, 0), (2, 0)], "query_idx int, pert_idx int")
    found = {r["query_idx"]: len(r["candidates"]) for r in retrieval.nest_hits(hits, queries=asked).collect()}
    assert found == {1: 150, 2: 0}
